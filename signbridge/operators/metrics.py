"""Evaluation metrics as DataFrame jobs.

* Set precision / recall / F1 per row and their macro mean (built-in array functions).
* Coordinate distance with padding (``zip_with``) and corpus totals.
* BLEU (4-gram, exp smoothing, effective order, 13a tokens) and chrF (char 6-grams,
  beta 2, whitespace removed): each row is reduced to its sufficient statistics by an
  Arrow-batched UDF (exact n-gram multiset intersection with numpy, no shuffle; one sort
  for all orders of many rows); the score is a closed form over the statistics, per row
  or over their corpus sums.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fsw import COORD_FILL

BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2
# Symbols of the pairs whose n-grams are counted together: what stays in a core's cache.
CHUNK_SYMBOLS = 1 << 14
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- set metrics (F10, D6, A4) ----------------------------------------------------------------

def set_prf(pred: Column, gold: Column) -> Column:
    """Precision, recall and F1 of two token lists taken as sets (empty side -> 0)."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    inter = F.size(F.array_intersect(p, g)).cast("double")
    prec = F.when(F.size(p) == 0, F.lit(0.0)).otherwise(inter / F.size(p))
    rec = F.when(F.size(g) == 0, F.lit(0.0)).otherwise(inter / F.size(g))
    return F.struct(prec.alias("precision"), rec.alias("recall"))


def f1_of(prec: Column, rec: Column) -> Column:
    return F.when((prec == 0) | (rec == 0), F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))


def with_set_metrics(df: DataFrame, pred: str, gold: str) -> DataFrame:
    m = set_prf(F.col(pred), F.col(gold))
    return df.withColumn("precision", m["precision"]).withColumn("recall", m["recall"]) \
             .withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def macro_means(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"),
                      F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("n_rows"))


# ---- positional alignment (J3, A14, A15) -------------------------------------------------------

def align_by_position(pred: DataFrame, gold: DataFrame, id_col: str = "row_id", enforce: bool = False) -> DataFrame:
    """Join two line tables on their line number (both carry ``id_col``). ``enforce`` makes a line that
    only one side has an error when the result is computed."""
    if not enforce:
        return pred.join(gold, id_col, "inner")
    a, b = pred.withColumn("_a", F.lit(True)), gold.withColumn("_b", F.lit(True))
    both = a.join(b, id_col, "full_outer")
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull(),
                F.raise_error(F.concat(F.lit("line on one side only: "), F.col(id_col).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(ok).drop("_a", "_b")


def alignment_report(pred: DataFrame, gold: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Line counts on both sides and lines present on one side only (must be 0, 0)."""
    a = pred.select(id_col).withColumn("_a", F.lit(1))
    b = gold.select(id_col).withColumn("_b", F.lit(1))
    j = a.join(b, id_col, "full_outer")
    return j.agg(
        F.count("_a").alias("n_pred"), F.count("_b").alias("n_gold"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("pred_only"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("gold_only"),
    ).withColumn("aligned", (F.col("pred_only") == 0) & (F.col("gold_only") == 0))


# ---- coordinate distance (J4, F15, A5) -------------------------------------------------------------

def padded_distance(pred: Column, gold: Column, fill: int = COORD_FILL) -> Column:
    """Sum of |p - g| over the longer of two int lists, the shorter padded with ``fill``."""
    diffs = F.zip_with(pred, gold, lambda a, b: F.abs(F.coalesce(a, F.lit(fill)) - F.coalesce(b, F.lit(fill))))
    return F.aggregate(diffs, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def padded_length(pred: Column, gold: Column) -> Column:
    return F.greatest(F.size(pred), F.size(gold)).cast("bigint")


def distance_totals(pairs: DataFrame, px: str, gx: str, py: str, gy: str) -> DataFrame:
    """Σ|Δx|, Σ|Δy|, padded token count (x side) and both means."""
    t = pairs.select(distances(px, gx, py, gy).alias("d"))
    return mean_distances(t.agg(*[F.sum(f"d.{a}").alias(b) for a, b in DISTANCE_TOTALS.items()]))


#: Fields of ``distances`` and the totals made of them.
DISTANCE_TOTALS = {"dx": "total_x", "dy": "total_y", "n": "tokens"}


def distances(px: str, gx: str, py: str, gy: str) -> Column:
    """A row's Σ|Δx|, Σ|Δy| and padded token count (x side)."""
    return F.struct(padded_distance(F.col(px), F.col(gx)).alias("dx"), padded_distance(F.col(py), F.col(gy)).alias("dy"),
                    padded_length(F.col(px), F.col(gx)).alias("n"))


def mean_distances(totals: DataFrame) -> DataFrame:
    """Add both means to the totals of ``distances``."""
    return totals.withColumn("mean_x", F.try_divide(F.col("total_x"), F.col("tokens").cast("double"))) \
            .withColumn("mean_y", F.try_divide(F.col("total_y"), F.col("tokens").cast("double")))


# ---- BLEU / chrF sufficient statistics -----------------------------------------------------------

# Fixed values of the 13a tokenizer (mteval-v13a): punctuation ranges, period/comma rules,
# dash after a digit.
_13A_RULES = [
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]
_ENDINGS = frozenset("!\"#$%&()*+/:;<=>?@[\\]^_`{|}~.,")  # what the rules part from any letter or digit before it
_13A_UNESCAPE = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


@functools.lru_cache(maxsize=1 << 16)
def _split_13a(word: str) -> tuple[str, ...]:
    """The tokens of a word between white space: no rule looks over it, or takes a character that another word needs."""
    if word.isalnum():
        return (word,)
    if word[:-1].isalnum() and word[-1] in _ENDINGS:
        return word[:-1], word[-1]
    word = f" {word} "
    for rx, repl in _13A_RULES:
        word = rx.sub(repl, word)
    return tuple(word.split())


def tokenize_13a(line: str) -> list[str]:
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        for a, b in _13A_UNESCAPE:
            line = line.replace(a, b)
    return list(itertools.chain.from_iterable(map(_split_13a, line.split())))


def _dense(ids: np.ndarray, other: np.ndarray):
    """Map two int sequences onto shared dense ids 0..k-1 (k distinct symbols)."""
    both = np.concatenate([ids, other])
    uniq, inv = np.unique(both, return_inverse=True)
    return inv[:len(ids)].astype(np.int64), inv[len(ids):].astype(np.int64), len(uniq)


def _gram_codes(ids: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Exact int64 code of every n-gram (base 2^bits digits), or void rows if too wide."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    if bits * n <= 63:
        code = ids[:m].copy()
        for j in range(1, n):
            code = (code << bits) | ids[j:j + m]
        return code
    win = np.lib.stride_tricks.sliding_window_view(ids, n)
    return np.ascontiguousarray(win).view(f"V{8 * n}").ravel()


def _clipped_all(h: np.ndarray, r: np.ndarray, orders: int) -> list[tuple[int, int, int]]:
    """Per order 1..orders: (hyp n-grams, ref n-grams, clipped matches)."""
    hd, rd, k = _dense(h, r)
    bits = max(1, int(k).bit_length())
    out = []
    for n in range(1, orders + 1):
        hc = _gram_codes(hd, n, bits)
        rc = _gram_codes(rd, n, bits)
        if len(hc) == 0 or len(rc) == 0:
            out.append((len(hc), len(rc), 0))
            continue
        hu, hn = np.unique(hc, return_counts=True)
        ru, rn = np.unique(rc, return_counts=True)
        _, hi, ri = np.intersect1d(hu, ru, assume_unique=True, return_indices=True)
        out.append((len(hc), len(rc), int(np.minimum(hn[hi], rn[ri]).sum())))
    return out


def _matches(grid: np.ndarray, tags: np.ndarray, bits: int, n_rows: int, orders: int) -> np.ndarray:
    """Clipped matches (rows x orders) of many pairs at once. ``grid`` holds the symbols of all texts, numbered from 1 in
    ``bits`` bits, with ``orders - 1`` zeros after each text; ``tags`` the row and, in the lowest bit, the side of each.

    A key is the row, the ``orders`` symbols from a place on, and the side. Sorted, the keys stand in groups of equal n-grams
    for every n, as a prefix of the longest; a group whose n-th symbol is 0 ran over the text's end."""
    two = grid << bits  # symbols are put together two by two (orders are even)
    two[:-1] |= grid[1:]
    key = two
    for j in range(2, orders, 2):
        key = key << 2 * bits
        key[:-j] |= two[j:]
    key = (key << 1) | tags
    key = key[grid > 0]
    out = np.zeros((n_rows, orders), np.int64)
    if not len(key):
        return out
    key.sort()
    change = key[1:] ^ key[:-1]
    refs = np.concatenate([[0], np.cumsum(key & 1)])
    begin = np.concatenate([[0], np.flatnonzero(change > 1) + 1])
    change = np.concatenate([[-1], change])[begin]
    key, ref, size = key[begin], np.append(refs[begin], refs[-1]), np.append(begin, len(key))
    for n in range(orders, 0, -1):
        shift = 1 + bits * (orders - n)
        if n < orders:  # a prefix begins where the longer one begins with another symbol before its last
            first = np.flatnonzero((change >> shift) != 0)
            change, key = change[first], key[first]
            ref, size = np.append(ref[first], ref[-1]), np.append(size[first], size[-1])
        in_ref = np.diff(ref)
        both = np.minimum(in_ref, np.diff(size) - in_ref)
        gram = key >> shift
        both[gram & ((1 << bits) - 1) == 0] = 0
        out[:, n - 1] = np.bincount(gram >> (bits * n), both, n_rows)
    return out


def _clipped_rows(grid: np.ndarray, lengths: np.ndarray, orders: int) -> np.ndarray:
    """Per pair and order: (hyp n-grams, ref n-grams, clipped matches), pairs x orders x 3. ``grid`` is as for ``_matches``,
    with the hypothesis before the reference of each pair; ``lengths`` (pairs x 2) are their numbers of symbols."""
    n_rows, pad = len(lengths), orders - 1
    out = np.zeros((n_rows, orders, 3), np.int64)
    out[:, :, :2] = np.maximum(lengths[:, None, :] - np.arange(orders)[None, :, None], 0)
    ends = np.concatenate([[0], np.cumsum(lengths.sum(axis=1) + 2 * pad)])
    lo = 0
    while lo < n_rows:
        hi = max(lo + 1, min(n_rows, int(np.searchsorted(ends, ends[lo] + CHUNK_SYMBOLS, side="right")) - 1))
        bits = int(grid[ends[lo]: ends[hi]].max(initial=0)).bit_length()
        if orders * bits > 62 - (hi - lo - 1).bit_length():
            hi = min(hi, lo + (1 << max(0, 62 - orders * bits)))
        part = grid[ends[lo]: ends[hi]]
        if orders * bits > 62:  # one pair of too many different symbols for a key of 64 bits
            h, r = lengths[lo]
            out[lo, :, 2] = [m for _, _, m in _clipped_all(part[:h], part[h + pad: h + pad + r], orders)]
        else:
            texts = np.arange(2 * (hi - lo))
            tags = np.repeat((texts >> 1) << (orders * bits + 1) | texts & 1, (lengths[lo:hi] + pad).ravel())
            out[lo:hi, :, 2] = _matches(part, tags, bits, hi - lo, orders)
        lo = hi
    return out


def bleu_rows(hyps: list, refs: list) -> np.ndarray:
    """[m1..m4, t1..t4, hyp_len, ref_len] of each segment (13a tokens)."""
    flat: list[int] = []
    lengths = np.zeros((len(hyps), 2), np.int64)
    pad = [0] * (BLEU_ORDER - 1)
    for i, pair in enumerate(zip(hyps, refs)):
        h, r = (tokenize_13a((text or "").strip()) for text in pair)
        lengths[i] = len(h), len(r)
        number = dict(zip(dict.fromkeys(h + r), itertools.count(1)))
        for tokens in (h, r):
            flat.extend(map(number.__getitem__, tokens))
            flat.extend(pad)
    found = _clipped_rows(np.array(flat, np.int64), lengths, BLEU_ORDER)
    return np.concatenate([found[:, :, 2], found[:, :, 0], lengths], axis=1)


def bleu_row_stats(hyp: str | None, ref: str | None) -> list[int]:
    """``bleu_rows`` of one segment."""
    return bleu_rows([hyp], [ref])[0].tolist()


def _codepoints(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def _char_rows(hyps: list[str], refs: list[str]) -> np.ndarray:
    """[h1..h6, r1..r6, m1..m6] of pairs of texts without white space."""
    out, lo = [np.zeros((0, 3 * CHRF_ORDER), np.int64)], 0
    pad = "\0" * (CHRF_ORDER - 1)
    sizes = np.cumsum([len(h) + len(r) for h, r in zip(hyps, refs)])
    while lo < len(hyps):  # characters are numbered anew in each part
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK_SYMBOLS, side="right")))
        texts = [t for pair in zip(hyps[lo:hi], refs[lo:hi]) for t in pair]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = _codepoints(pad.join(texts) + pad)
        seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
        seen[codes] = True
        grid = np.cumsum(seen)[codes]
        ends = np.cumsum(lengths + len(pad)) - len(pad)
        grid[(ends[:, None] + np.arange(len(pad))).ravel()] = 0
        found = _clipped_rows(grid, lengths.reshape(-1, 2), CHRF_ORDER)
        out.append(found.transpose(0, 2, 1).reshape(hi - lo, -1))
        lo = hi
    return np.concatenate(out)


def _no_space(texts: list) -> list[str]:
    return ["".join((t or "").split()) for t in texts]


def chrf_rows(hyps: list, refs: list, lowercase: bool = False) -> np.ndarray:
    """[h1..h6, r1..r6, m1..m6] of each segment: char n-grams, whitespace removed."""
    h, r = _no_space(hyps), _no_space(refs)
    return _char_rows([t.lower() for t in h], [t.lower() for t in r]) if lowercase else _char_rows(h, r)


def _case_matters(hyp: str, ref: str) -> bool:
    """Whether lower-casing a pair can make different characters equal, or change their number."""
    if not (hyp.isascii() and ref.isascii()):
        return True
    used = set(hyp) | set(ref)
    return any(c.lower() in used for c in used & _CAPITALS)


def chrf_rows_both(hyps: list, refs: list) -> np.ndarray:
    """``chrf_rows`` with case kept and lower-cased, side by side."""
    h, r = _no_space(hyps), _no_space(refs)
    kept = _char_rows(h, r)
    lower = kept.copy()
    other = [i for i, pair in enumerate(zip(h, r)) if _case_matters(*pair)]
    lower[other] = _char_rows([h[i].lower() for i in other], [r[i].lower() for i in other])
    return np.concatenate([kept, lower], axis=1)


def chrf_row_stats(hyp: str | None, ref: str | None, lowercase: bool = False) -> list[int]:
    """``chrf_rows`` of one segment."""
    return chrf_rows([hyp], [ref], lowercase)[0].tolist()


BLEU_FIELDS = [f"m{i}" for i in range(1, 5)] + [f"t{i}" for i in range(1, 5)] + ["hyp_len", "ref_len"]
CHRF_FIELDS = [f"h{i}" for i in range(1, 7)] + [f"r{i}" for i in range(1, 7)] + [f"c{i}" for i in range(1, 7)]


def _stats_type(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.LongType()) for f in fields])


def _frame(rows: np.ndarray, fields: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=fields, dtype="int64")


@F.pandas_udf(_stats_type(BLEU_FIELDS))
def bleu_stats(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    return _frame(bleu_rows(hyp.tolist(), ref.tolist()), BLEU_FIELDS)


def _chrf_udf(lowercase: bool):
    @F.pandas_udf(_stats_type(CHRF_FIELDS))
    def chrf_stats(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
        return _frame(chrf_rows(hyp.tolist(), ref.tolist(), lowercase), CHRF_FIELDS)
    return chrf_stats


chrf_stats = _chrf_udf(False)
chrf_stats_lower = _chrf_udf(True)

CHRF_BOTH_FIELDS = CHRF_FIELDS + [f"l{f}" for f in CHRF_FIELDS]


@F.pandas_udf(_stats_type(CHRF_BOTH_FIELDS))
def chrf_stats_both(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Case-kept and lower-cased statistics in one pass over the text."""
    return _frame(chrf_rows_both(hyp.tolist(), ref.tolist()), CHRF_BOTH_FIELDS)


LINE_FIELDS = BLEU_FIELDS + CHRF_BOTH_FIELDS


@F.pandas_udf(_stats_type(LINE_FIELDS))
def line_stats(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """All statistics of a pair, of BLEU and of chrF (case kept and lowered): what every score is a closed form of."""
    h, r = hyp.tolist(), ref.tolist()
    return _frame(np.concatenate([bleu_rows(h, r), chrf_rows_both(h, r)], axis=1), LINE_FIELDS)


def sum_stats(col: str) -> Column:
    """Aggregate: the sums over a column of ``line_stats``, in a struct of the same fields."""
    return F.struct(*[F.sum(F.col(f"{col}.{f}")).alias(f) for f in LINE_FIELDS])


def lower_stats(s: Column) -> Column:
    """The lower-cased chrF statistics of ``line_stats`` under the names that ``chrf_score`` reads."""
    return F.struct(*[s[f"l{f}"].alias(f) for f in CHRF_FIELDS])


def line_scores(lines: DataFrame, stats: str = "stats", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Per-line BLEU and chrF of lines that are not blank, from their stored statistics."""
    p = nonblank_pairs(lines, hyp, ref)
    return p.withColumn("bleu", bleu_score(F.col(stats))).withColumn("chrf", chrf_score(F.col(stats))).drop(stats)


def bleu_score(s: Column, effective_order: bool = True) -> Column:
    """BLEU (0-100) from a struct of statistics (per row or summed): exp smoothing for
    zero-match orders, effective order = orders before the first empty one. Without any
    match the score is 0; without ``effective_order`` it is 0 too where an order is empty."""
    m = [s[f"m{i}"] for i in range(1, 5)]
    t = [s[f"t{i}"] for i in range(1, 5)]
    logs, zeros = [], F.lit(0)
    for i in range(4):
        zeros = zeros + F.when(m[i] == 0, 1).otherwise(0)
        p = F.when(m[i] == 0, F.try_divide(F.lit(100.0), F.pow(F.lit(2.0), zeros) * t[i])) \
             .otherwise(F.try_divide(F.lit(100.0) * m[i], t[i].cast("double")))
        logs.append(F.log(p))
    eff = F.when(t[1] == 0, 1).when(t[2] == 0, 2).when(t[3] == 0, 3).otherwise(4)
    mean_log = F.when(eff == 1, logs[0]) \
        .when(eff == 2, (logs[0] + logs[1]) / 2) \
        .when(eff == 3, (logs[0] + logs[1] + logs[2]) / 3) \
        .otherwise((logs[0] + logs[1] + logs[2] + logs[3]) / 4)
    hyp, ref = s["hyp_len"], s["ref_len"]
    bp = F.when(hyp >= ref, F.lit(1.0)).when(hyp > 0, F.exp(1 - F.try_divide(ref, hyp.cast("double")))) \
          .otherwise(F.lit(0.0))
    zero = (t[0] == 0) | ((m[0] == 0) & (m[1] == 0) & (m[2] == 0) & (m[3] == 0))
    if not effective_order:
        zero = zero | (t[3] == 0)
    return F.when(zero, F.lit(0.0)).otherwise(bp * F.exp(mean_log))


def chrf_score(s: Column, beta: int = CHRF_BETA) -> Column:
    """chrF (0-100) from a struct of statistics: precision and recall averaged over the
    orders where both sides have n-grams, then F-beta."""
    psum, rsum, eff = F.lit(0.0), F.lit(0.0), F.lit(0)
    for i in range(1, 7):
        h, r, c = s[f"h{i}"], s[f"r{i}"], s[f"c{i}"]
        both = (h > 0) & (r > 0)
        psum = psum + F.when(both, F.try_divide(c, h.cast("double"))).otherwise(0.0)
        rsum = rsum + F.when(both, F.try_divide(c, r.cast("double"))).otherwise(0.0)
        eff = eff + F.when(both, 1).otherwise(0)
    p = F.when(eff == 0, 0.0).otherwise(F.try_divide(psum, eff.cast("double")))
    r = F.when(eff == 0, 0.0).otherwise(F.try_divide(rsum, eff.cast("double")))
    f2 = float(beta * beta)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(100.0 * (1 + f2) * p * r / (f2 * p + r))


def _sum_struct(col: str, fields: list[str]) -> list[Column]:
    return [F.sum(F.col(f"{col}.{f}")).alias(f) for f in fields]


def corpus_bleu(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", effective_order: bool = True) -> DataFrame:
    """Corpus BLEU: statistics of every row (blank rows included) summed, then scored;
    ``effective_order=False`` is the command line's form."""
    st = pairs.select(bleu_stats(F.col(hyp), F.col(ref)).alias("s"))
    tot = st.agg(*_sum_struct("s", BLEU_FIELDS))
    return tot.select(bleu_score(F.struct(*[F.col(f) for f in BLEU_FIELDS]), effective_order).alias("bleu"),
                      F.col("hyp_len"), F.col("ref_len"))


def corpus_chrf(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Corpus chrF with case kept and lower-cased."""
    st = pairs.select(chrf_stats_both(F.col(hyp), F.col(ref)).alias("s"))
    tot = st.agg(F.struct(*_sum_struct("s", CHRF_FIELDS)).alias("s"),
                 F.struct(*[F.sum(F.col(f"s.l{f}")).alias(f) for f in CHRF_FIELDS]).alias("l"))
    return tot.select(chrf_score(F.col("s")).alias("chrf"), chrf_score(F.col("l")).alias("chrf_lower"))


def nonblank_pairs(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Per-line scores skip lines where either side is blank."""
    from ..functions.text import strip
    return pairs.where((F.coalesce(F.length(strip(hyp)), F.lit(0)) > 0) &
                       (F.coalesce(F.length(strip(ref)), F.lit(0)) > 0))


def sentence_bleu(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    p = nonblank_pairs(pairs, hyp, ref)
    return p.withColumn("bleu", bleu_score(bleu_stats(F.col(hyp), F.col(ref))))


def sentence_chrf(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    p = nonblank_pairs(pairs, hyp, ref)
    return p.withColumn("chrf", chrf_score(chrf_stats(F.col(hyp), F.col(ref))))
