"""Registered queries of the composite jobs in ``plans.jobs`` over the driver tables, each with
oracle SQL written from the rules of the job, not from its code."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fsw as fx
from ..operators import attempts as at
from ..operators import embed as eb
from ..operators import embedding_store as es
from ..operators import prompts as pr
from ..operators import retrieval as rv
from ..operators import vocab as vc
from ..session import checkpoint, ensure_checkpoint_dir
from ..sources.tables import corpus_view, metric_pairs_view, read_table, sentence_text, signs_view
from . import jobs, metric_sql as ms, sqlparts as sq
from .queries import _SEEDS_SQL, _decomposed, _md5_rank, _round6, _sentence_signs, _sentence_vectors, _units, _vocab, _whole_vocab, register

# ---- C1: corpus preparation ------------------------------------------------------------------

#: Sign-bank rows made of documents: every third a sign, the others sentences; the synonym mark
#: stands for the full stop, so a text's first sentence is its first segment.
_BANK_COLUMNS = """doc_id row_id, '  ' || lang || ' ' spoken_language, ' ase' sign_language,
    case when doc_id % 3 = 0 then 'Sign ' else ' Sentence' end kind, replace(text, '. ', '᛫') texts,
    concat('M500x500S1', lpad(lower(hex(doc_id % 200)), 2, '0'), '00480x', cast(480 + doc_id % 20 as varchar(9))) sign"""


def _bank(spark, sf_dir):
    read_table(spark, sf_dir, "documents").createOrReplaceTempView("_bank_documents")
    bank = spark.sql(f"select {_BANK_COLUMNS} from _bank_documents")
    return bank.withColumnsRenamed({"kind": "Sentence/Sign", "texts": "annotated_texts_multilingual", "sign": "sign_writing"})


def _bank_sql(kind: str, text: str) -> str:
    return f"""bank as (select {_BANK_COLUMNS} from documents),
pick as (select row_id, {text} sentence, sign fsw from bank
         where trim(spoken_language) = 'en' and trim(sign_language) = 'ase' and trim(kind) = '{kind}' and texts is not null),
part as (select row_id, unnest(l) w, generate_subscripts(l, 1) p from (select row_id, string_split(sentence, '|') l from pick)),
cnt as (select row_id, {sq.lower_strip('w')} w, count(*) n, min(p) f from part group by all),
top as (select row_id, string_agg(w, '|' order by r) word
        from (select *, row_number() over (partition by row_id order by n desc, f) r from cnt) where r <= 2 group by row_id)"""


@register("prepare_corpus_signs", "with " + _bank_sql("Sign", "replace(texts, '᛫', '|')")
          + " select row_id, word, fsw from pick join top using (row_id)")
def q_prepare_signs(spark, sf_dir):
    return jobs.prepare_corpus(_bank(spark, sf_dir), "Sign").select("row_id", "word", "fsw")


_SENTENCES = "with " + _bank_sql("Sentence", "split_part(texts, '᛫', 1)") + f""",
rk as ({_md5_rank('pick', 'row_id', "'42'")}),
n as (select count(*) n from pick), held as (select (n * 5 + 99) // 100 held from n),
cut as (select row_id, sentence, fsw, case when rk < (held + 1) // 2 then 'test' when rk < held then 'dev' else 'train' end split
        from rk, held)"""


@register("prepare_corpus_sentences", _SENTENCES + """
select row_id, sentence, word, fsw, split from cut join top using (row_id)""")
def q_prepare_sentences(spark, sf_dir):
    return jobs.prepare_corpus(_bank(spark, sf_dir), "Sentence").select("row_id", "sentence", "word", "fsw", "split")


@register("prepare_corpus_reduced", _SENTENCES + f""",
tr as ({_md5_rank("(select * from cut where split = 'train')", 'row_id', "'42'")})
select row_id, split from tr, n where rk < n * 5 // 100
union all select row_id, split from cut where split <> 'train'""")
def q_prepare_reduced(spark, sf_dir):
    return jobs.prepare_corpus(_bank(spark, sf_dir), "Sentence", reduce_sentences=True).select("row_id", "split")


# ---- C2: vocabulary entries with all their words and signs, and their embedding -----------------------

_ENTRIES = f"""rows_ as (select {sq.key('fsw')} symbol, word, fsw, min(p_partkey) o from corpus group by 1, word, fsw),
entries as (select row_number() over (order by symbol) - 1 id, symbol, string_agg(word, '|' order by o) words,
                   string_agg(fsw, ', ' order by o) signs from rows_ group by symbol)"""
_LETTERS = "aeinorst"


def _letter_vector(text: str) -> str:
    return "[" + ", ".join(f"length({text}) - length(replace({text}, '{c}', ''))" for c in _LETTERS) + "]"


@register("vocabulary_entries", sq.with_(sq.WHOLE_CORPUS, _ENTRIES) + "select id, symbol, words, signs from entries")
def q_vocabulary_entries(spark, sf_dir):
    e = vc.entry_lists(corpus_view(spark, sf_dir))
    return e.select("id", "symbol", F.array_join("word", "|").alias("words"), F.array_join("fsw", ", ").alias("signs"))


@register("vocabulary_chunks", sq.with_(sq.WHOLE_CORPUS, _ENTRIES) + f""",
numbered as (select symbol, word, fsw, row_number() over (order by symbol, o) - 1 p from rows_),
starts as (select symbol, min(p) s, row_number() over (order by symbol) - 1 id from numbered group by symbol)
select id, symbol, p // {vc.CHUNK_ROWS} - s // {vc.CHUNK_ROWS} chunk, min(p) - s "first", string_agg(word, '|' order by p) words,
       string_agg(fsw, ', ' order by p) signs from numbered join starts using (symbol) group by id, symbol, s, p // {vc.CHUNK_ROWS}""")
def q_vocabulary_chunks(spark, sf_dir):
    e = vc.entry_chunks(corpus_view(spark, sf_dir))
    return e.select("id", "symbol", "chunk", "first", F.array_join("word", "|").alias("words"), F.array_join("fsw", ", ").alias("signs"))


def _embedded_vocabulary(spark, sf_dir):
    return jobs.build_vocabulary(corpus_view(spark, sf_dir), eb.letter_embedder(_LETTERS), order_col="p_partkey")


@register("vocabulary_embeddings", sq.with_(sq.WHOLE_CORPUS, _ENTRIES) + f"""
select id, symbol, array_to_string({_letter_vector('words')}, ',') vector from entries""")
def q_vocabulary_embeddings(spark, sf_dir):
    v = _embedded_vocabulary(spark, sf_dir)
    return v.select("id", "symbol", F.array_join(F.col("embedding").cast("array<int>").cast("array<string>"), ",").alias("vector"))


# ---- C4: unknown signs appended to the vocabulary, then looked up ----------------------------------------

APPENDED = 100


@register("lookup_after_append", sq.with_(sq.SIGNS, sq.CORPUS, sq.VOCAB, sq.UNITS) + f""",
freq as (select symbol, count(*) cnt from units where word = '<unk>' group by symbol),
unk as (select symbol, row_number() over (order by cnt desc, symbol) rank from freq order by cnt desc, symbol limit {APPENDED}),
pooled as (select array_to_string(list_sort(string_split(symbol, ' ')), ' ') key,
                  string_agg('unk_' || cast(rank as varchar), ' ' order by rank) word from unk group by 1)
select u.sentence_id, u.pos, u.symbol, coalesce(p.word, u.word) word
from units u left join pooled p on u.word = '<unk>' and p.key = u.key""")
def q_lookup_after_append(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    _, _, extended = jobs.profile_unknowns(_units(spark, sf_dir, vocab), vocab, APPENDED)
    return vc.lookup_signs(signs_view(spark, sf_dir), extended).select("sentence_id", "pos", "symbol", "word")


# ---- C5: training sets ----------------------------------------------------------------------------

@register("training_sets", sq.with_(sq.SIGNS, sq.CORPUS, sq.VOCAB, sq.UNITS, sq.DECOMPOSED) + f""",
filtered as (select sentence_id from decomposed where not contains(word, '<unk>')),
nf as (select count(*) n from filtered),
five as ({_md5_rank('filtered', 'sentence_id', "'42'")}),
seeds as (select * from (values {_SEEDS_SQL}) t(seed)),
x as (select seed, sentence_id from filtered, seeds),
abl as ({_md5_rank('x', 'sentence_id', 'cast(seed as varchar)', 'partition by seed')})
select 'full' variant, sentence_id from decomposed
union all select 'filtered', sentence_id from filtered
union all select 'filtered_5pct', sentence_id from five, nf where rk < n * 5 // 100
union all select 'ablation_' || cast(seed as varchar), sentence_id from abl, nf where rk < n * 5 // 100""")
def q_training_sets(spark, sf_dir):
    decomposed = _decomposed(spark, sf_dir).join(sentence_text(spark, sf_dir), "sentence_id")
    sets = jobs.build_training_sets(decomposed, corpus_view(spark, sf_dir), "sentence_id")
    out = sets["full"].select(F.lit("full").alias("variant"), "sentence_id")
    for name in ("filtered", "filtered_5pct"):
        out = out.unionByName(sets[name].select(F.lit(name).alias("variant"), "sentence_id"))
    seeded = F.concat(F.lit("ablation_"), F.col("seed").cast("string"))
    return out.unionByName(sets["ablation"].select(seeded.alias("variant"), "sentence_id"))


# ---- C9, C3: signs to units, sentences with their text ---------------------------------------------------

@register("map_signs", sq.with_(sq.SIGNS, sq.CORPUS, sq.VOCAB, sq.UNITS)
          + "select sentence_id, string_agg(word, ' # ' order by pos) units from units group by sentence_id")
def q_map_signs(spark, sf_dir):
    return jobs.map_signs_to_units(_sentence_signs(spark, sf_dir), _vocab(spark, sf_dir), "sentence_id")


# ---- C8: grounded answers ------------------------------------------------------------------------------------

@register("grounded_answers", sq.with_(sq.SIGNS, sq.WHOLE_CORPUS, sq.VOCAB, sq.UNITS, sq.DECOMPOSED, _ENTRIES) + f""",
answers as (select sentence_id q_id, replace(word, '<unk>', 'unknown sign') answer from decomposed),
u as (select q_id, unnest(l) unit, generate_subscripts(l, 1) pos from (select q_id, string_split(answer, '#') l from answers)),
uv as (select distinct unit, {_letter_vector('unit')} v from u),
vv as (select e.id, v.canonical_first2 canonical, v.fsw, {_letter_vector('e.words')} v from entries e join vocab v using (id)),
qn as ({sq.normalized('uv', 'unit', 'v')}),
cn as ({sq.normalized('vv', 'id', 'v', ', canonical, fsw')}),
near as (select * from (select q.id unit, c.id c_id, c.canonical, c.fsw, {sq.dot('q.v', 'c.v')} sim,
           row_number() over (partition by q.id order by {sq.dot('q.v', 'c.v')} desc, c.id) rank from qn q, cn c) where rank <= 10),
best as (select unit, arg_min(canonical, r) canonical, arg_min(fsw, r) fsw, arg_min(s, r) score
         from (select unit, canonical, fsw, rank + case when canonical = trim(unit) then 0 else 1000 end r,
                      case when canonical = trim(unit) then 1.0 else sim end s from near) group by unit)
select q_id, string_agg(fsw, ' ' order by pos) fsw_seq, string_agg(canonical, ' # ' order by pos) units,
       case when count(*) = 1 then round_even(product(score), 3) when product(score) >= 0
            then round_even(pow(product(score), 1.0 / count(*)), 3) end joint_prob
from u join best using (unit) group by q_id""")
def q_grounded_answers(spark, sf_dir):
    dec = _decomposed(spark, sf_dir, _units(spark, sf_dir, _whole_vocab(spark, sf_dir)))
    answers = dec.select(F.col("sentence_id").alias("q_id"), F.replace("word", F.lit("<unk>"), F.lit("unknown sign")).alias("answer"))
    out = jobs.ground_answers(answers, _embedded_vocabulary(spark, sf_dir), eb.letter_embedder(_LETTERS))
    return out.select("q_id", "fsw_seq", "units", "joint_prob")


# ---- X2, A12: answers asked for again ------------------------------------------------------------------

@register("retried_answers", sq.with_(sq.SIGNS, sq.CORPUS, sq.VOCAB, sq.UNITS, sq.DECOMPOSED) + """,
first_ as (select sentence_id q_id, word answer, list_transform(string_split(word, '#'), lambda x: trim(x)) l from decomposed),
flagged as (select q_id, answer, list_contains(l, '<unk>') or len(list_distinct(l)) < 0.2 * len(l) again from first_),
last_ as (select q_id, again, case when again then replace(answer, '<unk>', 'unknown sign') else answer end answer from flagged),
l as (select *, list_transform(string_split(answer, '#'), lambda x: trim(x)) l from last_)
select q_id, case when again then 2 else 1 end attempts, answer,
       list_contains(l, '<unk>') or len(list_distinct(l)) < 0.2 * len(l) needs_retry from l""")
def q_retried_answers(spark, sf_dir):
    """A model that answers with a sentence's units; asked again, it names unknown signs otherwise."""
    prompts = checkpoint(_decomposed(spark, sf_dir).select(F.col("sentence_id").alias("q_id"), "word"))

    def ask(rows, params):
        said = F.replace("word", F.lit("<unk>"), F.lit("unknown sign")) if "presence_penalty" in params else F.col("word")
        return rows.select("q_id", said.alias("answer"))

    path = f"{ensure_checkpoint_dir(spark)}/attempts-{uuid.uuid4().hex}"
    return at.last_answers(at.ask_with_retries(prompts, ask, path, parts=2))


# ---- X1: embeddings kept by the hash of their text -------------------------------------------------------

@register("stored_embeddings", f"""
select doc_id, array_to_string({_letter_vector('text')}, ',') vector from documents""")
def q_stored_embeddings(spark, sf_dir):
    """English documents are embedded first; the run over all documents embeds the rest and finds those."""
    docs, embed = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), eb.letter_embedder(_LETTERS)
    path = f"{ensure_checkpoint_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    es.store_embeddings(docs.where("lang = 'en'"), "text", path, "letters", embed)
    out = es.embed_stored(docs, "text", path, "letters", embed)
    return out.select("doc_id", F.array_join(F.col("embedding").cast("array<int>").cast("array<string>"), ",").alias("vector"))


# ---- P14, C10: answers and gold rows joined --------------------------------------------------------------------

@register("join_answers", """
select p.conv_id q_id, p.prompt, a.answer
from (select conv_id, string_agg(text, ' ' order by turn) prompt from conversations where role <> 'assistant' group by conv_id) p
left join (select conv_id, string_agg(text, ' ' order by turn) answer from conversations
           where role = 'assistant' and conv_id % 2 = 0 group by conv_id) a on a.conv_id = p.conv_id""")
def q_join_answers(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")

    def side(rows, name):
        items = F.array_sort(F.collect_list(F.struct("turn", "text")))
        return rows.groupBy(F.col("conv_id").alias("q_id")).agg(F.array_join(F.transform(items, lambda x: x["text"]), " ").alias(name))

    answers = conv.where((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0))  # a model that answers every other one
    return pr.join_answers(side(conv.where("role <> 'assistant'"), "prompt"), side(answers, "answer"))


@register("gold_join_many", """
with p as (select doc_id, case when doc_id % 7 = 0 then null else lang || cast(n_chars // 500 as varchar) end sentence from documents),
g as (select item_id, case when item_id % 7 = 0 then null else 'en' || cast(item_id as varchar) end sentence from benchmark)
select p.doc_id, p.sentence, g.item_id gold_cd from p join g on p.sentence is not distinct from g.sentence""")
def q_gold_join_many(spark, sf_dir):
    """Many-to-many keys, and null keys on both sides."""
    key = lambda c, text: F.when(F.col(c) % 7 != 0, text)
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    pred = docs.select("doc_id", key("doc_id", F.concat("lang", F.floor(F.col("n_chars") / 500).cast("string"))).alias("sentence"))
    gold = items.select(key("item_id", F.concat(F.lit("en"), F.col("item_id").cast("string"))).alias("sentence"),
                        F.lit("").alias("fsw"), F.lit("").alias("symbol"), F.col("item_id").alias("word"))
    return jobs.join_gold(pred, gold).select("doc_id", "sentence", "gold_cd")


# ---- K5: line-aligned columns ---------------------------------------------------------------------------------------

def _aligned_sql() -> str:
    def column(order: str, what: str, first: str) -> str:
        return f"array_to_string(list_concat([{first}], list_transform({order}(sy), lambda t: t.{what})), ' ')"
    columns = []
    for order, suffix in (("", ""), ("list_sort", "_ordered")):
        for name, what, first in (("symbols", "s", "b"), ("xs", "x", "bx"), ("ys", "y", "by_")):
            columns.append(f"string_agg({column(order, what, first)}, ' ' order by pos) {name}{suffix}")
    parts = rf"""signs_ as (select 0 part, sentence_id row_id, pos, fsw from signs union all select 1, p_partkey, 0, fsw from corpus),
per as (select part, row_id, pos, fsw, regexp_extract(fsw, '{sq.BOX_RE}', 1) b,
        cast(cast(regexp_extract(fsw, '{sq.BOX_RE}', 2) as int) as varchar) bx,
        cast(cast(regexp_extract(fsw, '{sq.BOX_RE}', 3) as int) as varchar) by_,
        list_transform({sq.syms('fsw')}, lambda x, i: {{'s': substr(x, 1, 6), 'i': i,
          'x': cast(cast(substr(x, 7, 3) as int) as varchar), 'y': cast(cast(substr(x, 11, 3) as int) as varchar)}}) sy from signs_),
text_ as (select 0 part, s.sentence_id row_id, string_agg(p.p_name, ' ' order by s.pos) sentence
          from signs s left join part p on p.p_partkey = s.k group by s.sentence_id
          union all select 1, p_partkey, word from corpus)"""
    return sq.with_(sq.SIGNS, sq.WHOLE_CORPUS, parts) + f"""
select cast(part as int) part, row_id, string_agg(fsw, ' ' order by pos) fsw, {', '.join(columns)}, any_value(sentence) sentence
from per join text_ using (part, row_id) group by part, row_id"""


@register("aligned_columns", _aligned_sql())
def q_aligned_columns(spark, sf_dir):
    signs = signs_view(spark, sf_dir)
    sentences = sentence_text(spark, sf_dir, signs).join(_sentence_signs(spark, sf_dir), "sentence_id").withColumnRenamed("sentence_id", "row_id")
    vocabulary = corpus_view(spark, sf_dir).withColumnRenamed("p_partkey", "row_id")
    return jobs.aligned_columns(sentences, vocabulary)


# ---- C6, C7: sign -> text prompts -----------------------------------------------------------------------------------

@register("prompts_sign_to_text", sq.with_(
    sq.SIGNS, sq.CORPUS, sq.VOCAB, sq.UNITS, sq.DECOMPOSED, sq.SENT_VEC) + f""",
stext as (select s.sentence_id, string_agg(p.p_name,' ' order by s.pos) sentence
          from signs s left join part p on p.p_partkey = s.k group by s.sentence_id),
queries as (select sentence_id q_id, word text, embedding from sent_vec where sentence_id % 100 = 0),
qs as ({sq.normalized("queries", "q_id", "embedding")}),
cs as ({sq.normalized("sent_vec", "sentence_id", "embedding",
                      f", (length(word)-length(replace(word,'<unk>','')))/5 > {rv.UNK_PENALTY_THRESHOLD} pen")}),
w1 as (select * from (select q.id q_id, c.id c_id,
                             row_number() over (partition by q.id order by
                               case when c.pen then 0.0 else {sq.dot('q.v', 'c.v')} end desc, c.id) rank
                      from qs q, cs c) where rank <= {rv.SENTENCE_EXAMPLES_S2T}),
ex as (select w1.q_id, st.sentence, d.word decomposition, row_number() over (partition by w1.q_id order by w1.rank) j
       from w1 join stext st on st.sentence_id = w1.c_id join decomposed d on d.sentence_id = w1.c_id
       where coalesce(length(st.sentence),0) > 0 and coalesce(length(d.word),0) > 0),
nex as (select q_id, count(*) n from ex group by q_id)
select q_id, 0::BIGINT msg_pos, 'system' role, '{pr.RULES_S2T}' content from queries
union all select q_id, 2*j-1, 'user', decomposition from ex
union all select q_id, 2*j, 'assistant', sentence from ex
union all select q_id, 2*coalesce(n,0)+1, 'user', '{pr.INSTRUCTION_S2T}' from queries left join nex using (q_id)
union all select q_id, 2*coalesce(n,0)+2, 'user', text from queries left join nex using (q_id)""")
def q_prompts_sign_to_text(spark, sf_dir):
    signs, vocab = signs_view(spark, sf_dir), _vocab(spark, sf_dir)
    dec = _decomposed(spark, sf_dir, vc.lookup_signs(signs, vocab))
    # the sentence table feeds the queries, the candidates and the examples: write it once
    sents = checkpoint(_sentence_vectors(spark, sf_dir, dec).join(sentence_text(spark, sf_dir, signs), "sentence_id")
                       .select("sentence_id", "sentence", "word", "embedding"))
    queries = sents.where(F.col("sentence_id") % 100 == 0).select(
        F.col("sentence_id").alias("q_id"), F.col("word").alias("text"), F.col("embedding").alias("q_vec"))
    return pr.explode_messages(jobs.build_prompts(queries, sents, vocab, "sign2text"))


# ---- P14: entries with several keys ------------------------------------------------------------------------------------

@register("lookup_list_keys", sq.with_(sq.WHOLE_CORPUS) + f"""
, e as (select p_partkey id, unnest(list_distinct([{sq.key('fsw')}, {sq.sym_ids('fsw')}[1]])) symbol, string_split(word, '|') l from corpus),
w as (select symbol, id, unnest(l) raw, generate_subscripts(l, 1) p from e),
o as (select symbol, {sq.lower_strip('raw')} word, row_number() over (partition by symbol order by id, p) o from w),
c as (select symbol, word, count(*) n, min(o) f from o group by symbol, word),
r as (select *, row_number() over (partition by symbol order by n desc, f) r from c)
select symbol, string_agg(word, '|' order by r) canonical, (select min(id) from e where e.symbol = r.symbol) id
from r where r <= 2 group by symbol""")
def q_lookup_list_keys(spark, sf_dir):
    """Entries under the key of their sign and under its first symbol alone; words of a shared key are pooled."""
    corpus = corpus_view(spark, sf_dir).select("p_partkey", "word", "fsw", fx.parse_sign("fsw").alias("parsed"))
    keys = F.array_distinct(F.array(fx.symbol_key("fsw"), F.element_at(fx.symbol_ids(F.col("parsed")), 1)))
    entries = corpus.select(F.col("p_partkey").alias("id"), keys.alias("symbol"), F.split("word", r"\|").alias("word"))
    return vc.lexicon_from_entries(entries).select("symbol", "canonical", "id")


# ---- C11, C12: evaluation ------------------------------------------------------------------------------------------

def _sign_pairs(spark, sf_dir):
    """Predicted signs: a sentence's own signs without the third; gold: all of them."""
    s = signs_view(spark, sf_dir)
    items = F.array_sort(F.collect_list(F.struct("pos", "fsw")))
    seq = s.groupBy(F.col("sentence_id").alias("row_id")).agg(items.alias("i"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x["fsw"]), " ")
    return seq.select("row_id", text(F.filter("i", lambda x: x["pos"] != 2)).alias("pred_fsw_seq"), text(F.col("i")).alias("gold_fsw_seq"))


def _symbols_sql(order: str, where: str) -> str:
    return rf"""(select sentence_id, string_agg(array_to_string(list_concat([regexp_extract(fsw, '{sq.BOX_RE}', 1)], {order}({sq.sym_ids('fsw')})), ' '),
        ' ' order by pos) s from signs {where} group by sentence_id)"""


def _sign_metric_sql(order: str) -> str:
    return f"""mp as (select g.sentence_id doc_id, coalesce(p.s, '') hyp, g.s ref
  from {_symbols_sql(order, '')} g left join {_symbols_sql(order, 'where pos <> 2')} p using (sentence_id))"""


def _sign_scores_sql(order: str, flag: str) -> str:
    sums = lambda fields, t: "(select " + ", ".join(f"sum({c})::BIGINT {c}" for c in fields) + f" from {t})"
    bleu = [f"m{i}" for i in range(1, 5)] + [f"t{i}" for i in range(1, 5)] + ["hyp_len", "ref_len"]
    chrf = [f"{k}{i}" for k in "hrc" for i in range(1, 7)]
    return "(" + sq.with_(sq.SIGNS) + ", " + ms.bleu_ctes(_sign_metric_sql(order)) + ",\n" + ms.chrf_ctes(False, "c") + f"""
select {flag} ordered, round(a.bleu, 6) + 0.0 bleu, round(b.chrf, 6) + 0.0 chrf
from {ms.bleu_formula(sums(bleu, 'brow'))} a, {ms.chrf_formula(sums(chrf, 'crow'))} b)"""


@register("evaluate_signs_scores", "select * from " + _sign_scores_sql("", "false") + " union all select * from " + _sign_scores_sql("list_sort", "true"))
def q_evaluate_signs_scores(spark, sf_dir):
    out = jobs.evaluate_signs(_sign_pairs(spark, sf_dir))
    both = out["bleu"].join(out["chrf"], "ordered")
    return both.select("ordered", _round6(F.col("bleu")).alias("bleu"), _round6(F.col("chrf")).alias("chrf"))


@register("evaluate_signs_lines", sq.with_(sq.SIGNS) + ", " + ms.bleu_ctes(_sign_metric_sql("")) + ",\n" + ms.chrf_ctes(False, "c") + f"""
select x.doc_id row_id, round(x.bleu, 6) + 0.0 bleu, round(y.chrf, 6) + 0.0 chrf
from {ms.bleu_formula('brow')} x join {ms.chrf_formula('crow')} y using (doc_id) join btk using (doc_id) where btk.nonblank""")
def q_evaluate_signs_lines(spark, sf_dir):
    out = jobs.evaluate_signs(_sign_pairs(spark, sf_dir))["per_line"]
    return out.select("row_id", _round6(F.col("bleu")).alias("bleu"), _round6(F.col("chrf")).alias("chrf"))


@register("evaluate_signs_f1", sq.with_(sq.SIGNS) + f""",
g as (select sentence_id, list_distinct(flatten(list({sq.sym_ids('fsw')}))) t, list_distinct(flatten(coalesce(list({sq.sym_ids('fsw')})
      filter (where pos <> 2), []))) h from signs group by sentence_id),
m as (select sentence_id row_id, case when len(h) = 0 then 0.0 else len(list_intersect(h, t))::DOUBLE / len(h) end p,
             case when len(t) = 0 then 0.0 else len(list_intersect(h, t))::DOUBLE / len(t) end r from g)
select row_id, round(p, 6) + 0.0 "precision", round(r, 6) + 0.0 recall,
       round(case when p = 0 or r = 0 then 0.0 else 2 * p * r / (p + r) end, 6) + 0.0 f1 from m""")
def q_evaluate_signs_f1(spark, sf_dir):
    out = jobs.evaluate_signs(_sign_pairs(spark, sf_dir))["f1_rows"]
    return out.select("row_id", *[_round6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


# every eleventh hypothesis has no word in common with its text
_TEXT_PAIRS = r"""mp as (select doc_id, case when doc_id % 11 = 0 then 'QQQ 77 ## QQQ' else hyp end hyp, ref
  from (select doc_id, array_to_string(list_filter(w, lambda x, i: (i-1)%7<>3),' ') hyp, array_to_string(w,' ') ref
        from (select doc_id, string_split(regexp_replace(text,'\s+',' ','g'),' ') w from documents)))"""


@register("evaluate_text", "with " + ms.bleu_ctes(_TEXT_PAIRS) + ",\n" + ms.chrf_ctes(False, "c") + f"""
select x.doc_id, round(x.bleu, 6) + 0.0 bleu, round(y.chrf, 6) + 0.0 chrf
from {ms.bleu_formula('brow')} x join {ms.chrf_formula('crow')} y using (doc_id) join btk using (doc_id) where btk.nonblank""")
def q_evaluate_text(spark, sf_dir):
    pairs = metric_pairs_view(spark, sf_dir)
    pairs = pairs.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "QQQ 77 ## QQQ").otherwise(F.col("hyp")).alias("pseudo_sentence"),
                         F.col("ref").alias("sentence"))
    out = jobs.evaluate_text(pairs)["per_line"]
    return out.select("doc_id", _round6(F.col("bleu")).alias("bleu"), _round6(F.col("chrf")).alias("chrf"))
