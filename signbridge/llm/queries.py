"""The ``opN_<name>`` queries: each applies its operator to whole tables and derives the
digest columns of its result. ``ORACLE`` holds DuckDB SQL where SQL can express a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from signbridge.llm import bpe, decontamination, html_text, language, licences, merkle, near_duplicates, neighbours, periodic_runs, quality, token_store, toxicity, warc
from signbridge.llm.common import held_out, scratch_path, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN).drop("token_ids")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of low quality, 1 good but toxic, 2 good."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(F.col("quality") * 2 - F.col("toxic")).alias("grade"))
    out = quality.rate(docs, quality.fit(docs, ratings), grade=1)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "p_grade", "selected")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = licences.hits(docs)
    found = licences.scan(docs, licences.train(docs, hits), found=hits)
    return found.select("doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"),
                        F.array_join("families", ",").alias("families"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.documents_manifest(docs, tampered)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                        "folded_root", "verified")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", periodic_runs.longest())
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*",
                        F.sha2(periodic_runs.run_lines(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_licences": op7_licences,
    "op8_decontamination": op8_decontamination,
    "op9_html_text": op9_html_text,
    "op10_neighbours": op10_neighbours,
    "op11_warc": op11_warc,
    "op12_merkle": op12_merkle,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op4_near_duplicates": rf"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                  '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, w[i:i + least(len(w), 4) - 1] g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
e as (select x, y from (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
                        group by 1, 2)
      join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
r as (select doc_id x, doc_id y from n union select r.x, e.y from r join e on r.y = e.x),
m as (select x, min(y) m from r group by x)
select doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.m, doc_id) component_id, coalesce(m.m, doc_id) = doc_id kept
from d left join n using (doc_id) left join m on m.x = doc_id""",
    "op8_decontamination": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
g as (select distinct item_id, k, w[i:i + k - 1] gram
      from (select item_id, w, least(len(w), 10) k, unnest(range(1, len(w) - least(len(w), 10) + 2)) i
            from b where len(w) > 0)),
t as (select doc_id, i, k, w[i:i + k - 1] gram
      from (select doc_id, w, i, unnest((select list(distinct k) from g)) k
            from (select doc_id, w, unnest(range(1, len(w) + 1)) i from d)) where i + k - 1 <= len(w)),
h as (select t.doc_id, t.i, t.k, g.item_id from t join g on t.k = g.k and t.gram = g.gram),
p as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from h) group by doc_id),
q as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
      from (select distinct doc_id, cast(item_id as varchar) item from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, coalesce(p.n_hit, 0) n_hit, coalesce(q.n_items, 0) n_items,
       sha256(coalesce(q.items, '')) items_sha256, coalesce(p.n_hit, 0) > 0 contaminated
from d left join p using (doc_id) left join q using (doc_id)""",
}

# crc32 of the decimal id ``doc_id`` as SQL: a table of 256 entries from the reflected polynomial, then one step for each byte
_CRC_STEP = "case when {c} & 1 = 1 then xor({c} >> 1, 3988292384) else {c} >> 1 end"


def _crc_rows() -> str:
    steps = ["select i, i::bigint c0 from range(256) r(i)"]
    for k in range(8):
        steps.append(f"select i, {_CRC_STEP.format(c=f'c{k}')} c{k + 1} from ({steps[-1]})")
    return f"select list(c8 order by i) x from ({steps[-1]})"


_CRC = ("xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda j: ascii(substr(doc_id::varchar, j, 1))::bigint), "
        "lambda c, b: xor(c >> 8, crc.x[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295::bigint)")

ORACLE |= {
    "op11_warc": """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) h from pages),
f as (select h, min(page_id) m from p group by h),
d as (select h, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, ((i // 4) * 5 + 1)::int, 5))::int >> (5 * (3 - i % 4))::int) & 31) + 1)::int, 1)), lambda a, b: a || b) digest
      from (select distinct h from p where h is not null))
select page_id, n payload_bytes, digest payload_digest, case when page_id = m then 'response' else 'revisit' end record_type,
       case when page_id <> m then m end refers_to
from p join f using (h) join d using (h)""",
    "op12_merkle": f"""
with recursive crc as ({_crc_rows()}),
f as (select *, coalesce('=' || lang, '') part, {{leaf}} leaf,
             case when doc_id is not null and {_CRC} % 7 = 0 then {{tampered}} else {{leaf}} end tampered from documents, crc),
l as (select *, row_number() over (partition by part order by doc_id nulls first) - 1 pos, count(*) over (partition by part) n from f),
t as (select part, 0 lv, pos, n, leaf h from l
      union all
      select part, lv + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by part, lv, pos // 2, n),
s as (select part, row_number() over (order by part) - 1 tpos, count(*) over () tn, h subroot from t where n = 1),
u as (select 0 lv, tpos pos, tn n, subroot h from s
      union all
      select lv + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from u where n > 1 group by lv, pos // 2, n),
way as (select l.part, l.pos, t.lv, t.h, l.pos >> t.lv::int p from l join t on t.part = l.part and t.pos = xor(l.pos >> t.lv::int, 1)),
proof as (select part, pos, lv, p, h from way
          union all
          select l.part, l.pos, 1000 + u.lv, s.tpos >> u.lv::int, u.h from l join s using (part) join u on u.pos = xor(s.tpos >> u.lv::int, 1)),
joined as (select part, pos, string_agg(h, '' order by lv) w from proof group by 1, 2),
c as (select l.part, l.pos, 0 lv, l.pos p, l.n, l.tampered h from l
      union all
      select c.part, c.pos, c.lv + 1, c.p // 2, (c.n + 1) // 2,
             sha256(case when c.p % 2 = 1 then coalesce(t.h, '') || c.h else c.h || coalesce(t.h, '') end)
      from c left join t on t.part = c.part and t.lv = c.lv and t.pos = xor(c.p, 1) where c.n > 1),
e as (select c.part, c.pos, 0 lv, s.tpos p, s.tn n, c.h from c join s using (part) where c.n = 1
      union all
      select e.part, e.pos, e.lv + 1, e.p // 2, (e.n + 1) // 2,
             sha256(case when e.p % 2 = 1 then coalesce(u.h, '') || e.h else e.h || coalesce(u.h, '') end)
      from e left join u on u.lv = e.lv and u.pos = xor(e.p, 1) where e.n > 1)
select l.doc_id, l.leaf, s.subroot, r.h root, sha256(coalesce(j.w, '')) proof_sha256, e.h folded_root, e.h = r.h verified
from l join s using (part) join (select h from u where n = 1) r on true join e on e.part = l.part and e.pos = l.pos and e.n = 1
left join joined j on j.part = l.part and j.pos = l.pos""",
    "op13_periodic_runs": rf"""
with crc as ({_crc_rows()}),
w0 as (select doc_id, case when doc_id is null then 1 else {_CRC} end h,
              list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents, crc),
w1 as (select doc_id, w, len(w) n, h, h // 10 g, (h // 10) % greatest(len(w), 1) a from w0),
d as (select doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i:
             w[(case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end) + 1]) else w end w from w1),
x as (select doc_id, unnest(range(len(w))) i, unnest(w) v, len(w) n from d),
k as (select doc_id, i, n, v || ' ' || lead(v) over o || ' ' || lead(v, 2) over o || ' ' || lead(v, 3) over o || ' ' || lead(v, 4) over o
             || ' ' || lead(v, 5) over o k from x window o as (partition by doc_id order by i)),
m as (select a.doc_id, b.i - a.i q, a.i from k a join k b on a.doc_id = b.doc_id and a.k = b.k and a.i < b.i
      where 2 * (b.i - a.i) <= a.n),
s as (select doc_id, q, min(i) s, max(i) + 6 + q - min(i) l
      from (select *, i - row_number() over (partition by doc_id, q order by i) o from m) group by doc_id, q, o),
r as (select doc_id, s, l, min(q) q from s where l >= greatest(12, 2 * q) group by doc_id, s, l),
b as (select doc_id, count(*) n_runs, arg_min(r, [-l, s, q]) best, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) lines
      from r group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) i from r),
kept as (select x.doc_id, string_agg(v, ' ' order by x.i) c from x anti join gone on gone.doc_id = x.doc_id and gone.i = x.i group by x.doc_id)
select d.doc_id, coalesce(b.n_runs, 0) n_runs, b.best.s "start", b.best.l length, b.best.q period,
       1000 * b.best.l // b.best.q exponent_milli, sha256(coalesce(b.lines, '')) runs_sha256, sha256(coalesce(kept.c, '')) collapsed_sha256
from d left join b using (doc_id) left join kept using (doc_id)""",
}


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


ORACLE["op12_merkle"] = ORACLE["op12_merkle"].format(leaf=_leaf_sql("n_chars"), tampered=_leaf_sql("(n_chars + 1)"))

if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
