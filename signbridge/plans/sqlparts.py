"""Portable SQL fragments for the oracle queries (DuckDB dialect).

They mirror the derived views in ``sources.tables`` so that the DuckDB side reads the
same driver tables the Spark side reads.
"""

from __future__ import annotations

SYMBOL_RE = r"S[123][0-9a-f]{2}[0-5][0-9a-f]\d{3}x\d{3}"
BOX_RE = r"([BLMR])(\d{3})x(\d{3})"


def box(k: str) -> str:
    return (f"concat(substr('MLRB',cast({k}%4+1 as int),1),cast(500+{k}%100 as varchar),'x',"
            f"cast(500+{k}%90 as varchar))")


def sym1(k: str) -> str:
    return (f"concat('S1',lpad(lower(hex({k}%40)),2,'0'),'0',lower(hex({k}%3)),"
            f"cast(450+{k}%100 as varchar),'x',cast(460+{k}%80 as varchar))")


def sym2(k: str) -> str:
    return (f"concat('S2',lpad(lower(hex({k}%7)),2,'0'),'00',cast(455+{k}%60 as varchar),'x',"
            f"cast(465+{k}%70 as varchar))")


SIGNS = f"""signs as (
  select l_orderkey sentence_id,
         row_number() over (partition by l_orderkey
                            order by l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 pos,
         l_partkey k,
         case when l_orderkey%2=0 then concat({box('l_partkey')},{sym1('l_partkey')},{sym2('l_partkey')})
              else concat({box('l_partkey')},{sym2('l_partkey')},{sym1('l_partkey')}) end fsw
  from lineitem)"""

CORPUS = f"""corpus as (
  select p_partkey, concat(p_name,'|',lower(p_type)) word,
         concat({box('p_partkey')},{sym1('p_partkey')},{sym2('p_partkey')}) fsw
  from part where p_partkey%5<>0)"""

# The corpus of all parts, for queries that need no unknown signs.
WHOLE_CORPUS = CORPUS.replace(" where p_partkey%5<>0", "")


def syms(fsw: str) -> str:
    return f"regexp_extract_all({fsw},'{SYMBOL_RE}')"


def sym_ids(fsw: str) -> str:
    return f"list_transform({syms(fsw)}, lambda x: substr(x,1,6))"


def key(fsw: str) -> str:
    return f"array_to_string(list_sort({sym_ids(fsw)}),' ')"


def written(fsw: str) -> str:
    return f"array_to_string({sym_ids(fsw)},' ')"


def lower_strip(x: str) -> str:
    return rf"regexp_replace(lower({x}),'^\s+|\s+$','','g')"


# Vocabulary: words long form, counted top-2 canonical, first-2 distinct, sign mode, ids.
VOCAB = f"""corpus_d as (select word, fsw, min(p_partkey) p_partkey from corpus group by word, fsw),
vw as (select symbol, ord, fsw, unnest(l) w, generate_subscripts(l,1) wpos
       from (select {key('fsw')} symbol, p_partkey ord, fsw, string_split(word,'|') l from corpus_d)),
vo as (select symbol, {lower_strip('w')} w, row_number() over (partition by symbol order by ord, wpos) o
       from vw),
vc as (select symbol, w, count(*) n, min(o) f from vo group by symbol, w),
canon as (select symbol, string_agg(w,'|' order by r) canonical
          from (select *, row_number() over (partition by symbol order by n desc, f) r from vc)
          where r<=2 group by symbol),
first2 as (select symbol, string_agg(w,'|' order by r) canonical_first2
           from (select *, row_number() over (partition by symbol order by f) r from vc)
           where r<=2 group by symbol),
fmode as (select symbol, fsw from (
            select symbol, fsw, row_number() over (partition by symbol order by n desc, f) r
            from (select symbol, fsw, count(*) n, min(ord) f from vw where wpos=1 group by symbol, fsw))
          where r=1),
sizes as (select symbol, count(distinct ord) n_rows, count(*) n_words from vw group by symbol),
vocab as (select row_number() over (order by s.symbol)-1 id, s.symbol, c.canonical, f2.canonical_first2,
                 m.fsw, s.n_rows, s.n_words
          from sizes s join canon c using (symbol) join first2 f2 using (symbol) join fmode m using (symbol))"""

UNITS = f"""units as (
  select s.sentence_id, s.pos, s.k, s.fsw, {written('s.fsw')} symbol, {key('s.fsw')} key,
         coalesce(v.canonical,'<unk>') word, v.id entry_id
  from signs s left join vocab v on {key('s.fsw')} = v.symbol)"""

DECOMPOSED = """decomposed as (
  select sentence_id, string_agg(fsw,' ' order by pos) fsw, string_agg(symbol,' | ' order by pos) symbol,
         string_agg(word,' # ' order by pos) word, count(*) n_signs,
         count(*) filter (where word='<unk>') n_unk
  from units group by sentence_id)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def normalized(table: str, id_expr: str, vec: str, extra: str = "") -> str:
    """Rows (id, v) with v the L2-normalised double vector (zero stays zero)."""
    return (f"select {id_expr} id, list_transform(v0, lambda x: coalesce(x / nullif(nrm, 0), 0)) v{extra} "
            f"from (select *, sqrt(list_sum(list_transform(v0, lambda y: y*y))) nrm "
            f"from (select *, list_transform({vec}, lambda x: x::DOUBLE) v0 from {table}))")


N_EMB = "(select count(*) from embeddings)"

SENT_VEC = """sent_vec as (select d.sentence_id, d.word, e.embedding
  from decomposed d join embeddings e on e.vec_id = d.sentence_id % (select count(*) from embeddings))"""

VOCAB_VEC = f"""vocab_vec as (select v.*, e.embedding
  from vocab v join embeddings e on e.vec_id = v.id % {N_EMB})"""

QVEC = "qn as (" + normalized("embeddings", "vec_id", "embedding") + ")"


def dot(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}), 12)"
