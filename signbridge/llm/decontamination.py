"""Benchmark decontamination: documents are scanned for word windows of benchmark items.

Method: a broadcast hash set of the normalised n-grams of all items; every token window of
every document is looked up by its 64-bit hash, a hit is verified on the words themselves,
and the words below verified windows are marked. Only DataFrame functions are used.

Rules. A-Z are lower-cased; a word is a run of letters, digits and non-ASCII characters. An
item gives all windows of ``n`` consecutive words; an item of fewer words, but not none, is
one window. Null and empty texts have no words: such an item marks nothing, such a document
stays clean. Repeated documents are judged each on its own, also under one id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signbridge.llm.common import ASCII_LOWER, ASCII_UPPER, fits, stored

#: Characters between words, after and before lower-casing.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
BREAKS_ANY_CASE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: The n-gram set is broadcast up to this size, measured before; beyond it the join is shuffled.
MAX_SET_BYTES = 64 << 20


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.array_remove(F.split(lowered, f"[{BREAKS}]+"), "")


def benchmark_grams(benchmark: DataFrame, n: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of all items: gram ARRAY<STRING>, width, items (ids as strings)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)
    grams = items.select("item", "width", "w", F.explode(starts).alias("at"))
    grams = grams.select("width", F.slice("w", F.col("at"), F.col("width")).alias("gram"),
                         F.coalesce("item", F.lit("")).alias("item"))
    return grams.groupBy("gram", "width").agg(F.collect_set("item").alias("items"))


def scan(docs: DataFrame, grams: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its columns ``_row`` and ``_id`` pass through; adds n_words,
    spans (array of start, width; start counts words from 0) and items (sorted ids)."""
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect())  # at most n values
    tokens = docs.select("_row", "_id", words(F.col(text)).alias("_words"))
    if not widths:
        return tokens.select("_row", "_id", F.size("_words").cast("long").alias("n_words"),
                             F.lit(None).cast("array<struct<start:int,width:int>>").alias("spans"),
                             F.lit(None).cast("array<string>").alias("items"))
    at = tokens.select("_row", "_id", "_words", F.posexplode_outer("_words").alias("start", "_word"))
    if len(widths) > 1:
        at = at.withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    else:
        at = at.withColumn("width", F.lit(widths[0]))
    at = at.withColumn("window", F.when(F.col("start") + F.col("width") <= F.size("_words"),
                                        F.slice("_words", F.col("start") + 1, F.col("width"))))
    at = at.select("_row", "_id", F.size("_words").cast("long").alias("n_words"), "start", "width", "window",
                   F.when(F.col("window").isNotNull(), F.xxhash64("window")).alias("key"))
    known = grams.select(F.xxhash64("gram").alias("key"), "gram", "items")
    size = F.lit(64) + F.length(F.concat_ws("", "gram")) + F.length(F.concat_ws("", "items")) + 16 * (F.size("gram") + F.size("items"))
    if fits(known, MAX_SET_BYTES, size):
        known = F.broadcast(known)
    found = at.join(known, (at["key"] == known["key"]) & (at["window"] == known["gram"]), "left")
    found = found.where(F.col("gram").isNotNull() | F.col("start").isNull()
                        | ((F.col("start") == 0) & (F.col("width") == widths[0])))  # a row for each document
    hit = F.col("gram").isNotNull()
    return found.groupBy("_row", "_id").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("start", "width"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col("items"))))).alias("items"))


def covered() -> Column:
    """Distinct word positions below ``spans``."""
    return F.array_distinct(F.flatten(F.transform(
        F.coalesce("spans", F.array()), lambda s: F.sequence(s["start"], s["start"] + s["width"] - 1))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items, contaminated."""
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), text)
    found = scan(keyed, benchmark_grams(benchmark, n), text)
    found = found.withColumn("n_hit", F.size(covered()).cast("long"))
    items = F.coalesce("items", F.array())
    return found.select(F.col("_id").alias(doc_id), F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"),
                        "n_hit", F.size(items).cast("long").alias("n_items"),
                        items.alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents",
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with the words
    below benchmark windows cut from their texts (``remove="spans"``). Columns stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    # a row is known by id and text, so that rows read again by another plan meet their verdict
    keyed = docs.select(F.xxhash64(text).alias("_row"), F.col(doc_id).alias("_id"), text)
    found = scan(keyed, benchmark_grams(benchmark, n), text)
    hits = found.select(F.col("_row").alias("_hit_row"), F.col("_id").alias("_hit_id"), covered().alias("_cut"))
    hits = stored(hits.where(F.size("_cut") > 0), "leaks")
    if fits(hits, MAX_SET_BYTES, 64 + 4 * F.size("_cut")):
        hits = F.broadcast(hits)
    same = (F.xxhash64(docs[text]) == hits["_hit_row"]) & docs[doc_id].eqNullSafe(hits["_hit_id"])
    if remove == "documents":
        return docs.join(hits, same, "left_anti")
    pieces = F.regexp_extract_all(docs[text], F.lit(f"[{BREAKS_ANY_CASE}]*[^{BREAKS_ANY_CASE}]+"), F.lit(0))
    tail = F.regexp_extract(docs[text], f"[{BREAKS_ANY_CASE}]*$", 0)
    rest = F.concat(F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(hits["_cut"], i)), ""), tail)
    cut = F.when(hits["_cut"].isNull(), docs[text]).otherwise(rest).alias(text)
    return docs.join(hits, same, "left").select(*(cut if c == text else docs[c] for c in docs.columns))
