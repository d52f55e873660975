"""Driver tables and the derived views built from them (signs, corpus, metric pairs).

Every view is a lazy DataFrame over the parquet scans, so filters and column pruning
reach the scan and the work grows with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Natural key of each driver table: used to spread a scan that yields too few partitions.
TABLE_KEYS = {
    "lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id", "conversations": "conv_id", "events": "event_id",
}


# Scans smaller than this are not worth an extra shuffle stage.
SPREAD_MIN_BYTES = 4 * 1024 * 1024


_SIZE_CACHE: dict[tuple[str, str], int] = {}


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (file listing only, contents not read);
    remembered per application, since input tables do not change under a running job."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SIZE_CACHE:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        _SIZE_CACHE[key] = int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    return _SIZE_CACHE[key]


def spread(df: DataFrame, key: str | None, path: str) -> DataFrame:
    """Hash-partition ``df`` by ``key`` when a large scan yields fewer partitions than the
    cluster has cores (e.g. one big row group). Inputs with many splits, and small ones,
    are left as they are. Hash partitioning is deterministic on retry and pre-partitions
    later per-key windows and aggregates on the same key."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if key is None or df.rdd.getNumPartitions() >= cores:
        return df
    if input_bytes(spark, path) < SPREAD_MIN_BYTES:
        return df
    return df.repartition(cores, key)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spread(spark.read.parquet(path), TABLE_KEYS.get(name), path)


# Bytes of a table's files behind each partition of ``by_key``.
KEYED_BYTES = 4 * 1024 * 1024


def by_key(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table hash-partitioned by its key, in parts of bounded size, so that aggregates and windows by key and more
    need no other shuffle."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    parts = max(spark.sparkContext.defaultParallelism, -(-input_bytes(spark, path) // KEYED_BYTES))
    return spark.read.parquet(path).repartition(parts, TABLE_KEYS[name])


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every driver table plus the derived views as temp views."""
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
    signs_view(spark, sf_dir).createOrReplaceTempView("signs")
    known_corpus_view(spark, sf_dir).createOrReplaceTempView("corpus")
    metric_pairs_view(spark, sf_dir).createOrReplaceTempView("metric_pairs")


# ---- synthetic sign strings keyed by a part key --------------------------------------

def _s(c: Column) -> Column:
    return c.cast("string")


def box_token(k: Column) -> Column:
    """Box of a sign: one of M/L/R/B plus its centre, e.g. ``B511x501``."""
    letter = F.substring(F.lit("MLRB"), (k % 4 + 1).cast("int"), 1)
    return F.concat(letter, _s(500 + k % 100), F.lit("x"), _s(500 + k % 90))


def symbol1_token(k: Column) -> Column:
    return F.concat(
        F.lit("S1"), F.lpad(F.lower(F.hex(k % 40)), 2, "0"), F.lit("0"), F.lower(F.hex(k % 3)),
        _s(450 + k % 100), F.lit("x"), _s(460 + k % 80),
    )


def symbol2_token(k: Column) -> Column:
    return F.concat(
        F.lit("S2"), F.lpad(F.lower(F.hex(k % 7)), 2, "0"), F.lit("00"),
        _s(455 + k % 60), F.lit("x"), _s(465 + k % 70),
    )


def signs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sign: an order is a sentence, each of its line items one sign.

    Columns: sentence_id BIGINT, pos BIGINT (0-based sign position), k BIGINT (part key),
    fsw STRING. Odd orders write the two symbols in swapped order, so only the
    order-free key matches them to the vocabulary.
    """
    # renamed before the window, so that what comes after it is known to be partitioned by sentence
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sentence_id"), F.col("l_partkey").alias("k"), "l_suppkey", "l_linenumber", "l_extendedprice")
    w = Window.partitionBy("sentence_id").orderBy("l_linenumber", "k", "l_suppkey", "l_extendedprice")
    pos = (F.row_number().over(w) - 1).cast("bigint")
    li = li.select("sentence_id", pos.alias("pos"), "k")
    k = F.col("k")
    fsw = F.when(F.col("sentence_id") % 2 == 0,
                 F.concat(box_token(k), symbol1_token(k), symbol2_token(k))) \
           .otherwise(F.concat(box_token(k), symbol2_token(k), symbol1_token(k)))
    return li.select("sentence_id", "pos", "k", fsw.alias("fsw"))


def corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary source rows ``(p_partkey, word 'a|b', fsw)``, one for each part."""
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(
        k,
        F.concat(F.col("p_name"), F.lit("|"), F.lower(F.col("p_type"))).alias("word"),
        F.concat(box_token(k), symbol1_token(k), symbol2_token(k)).alias("fsw"),
    )


def known_corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of the lookup fixture: every fifth part has no entry, so that the signs made of it
    are unknown. Only queries about unknown signs use it."""
    return corpus_view(spark, sf_dir).where(F.col("p_partkey") % 5 != 0)


def metric_pairs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothesis/reference pairs over whole documents: the reference is the document with
    whitespace runs folded to one space; the hypothesis drops every 7th word."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.split(F.regexp_replace(F.col("text"), r"\s+", " "), " ")
    return docs.select(
        "doc_id",
        F.array_join(F.filter(words, lambda x, i: i % 7 != 3), " ").alias("hyp"),
        F.array_join(words, " ").alias("ref"),
    )


def sentence_text(spark: SparkSession, sf_dir: str, signs: DataFrame | None = None) -> DataFrame:
    """Sentence text of an order: the part names of its signs in sign order."""
    signs = signs if signs is not None else signs_view(spark, sf_dir)
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return (
        signs.join(part, "k", "left")
        .groupBy("sentence_id")
        .agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "p_name"))), lambda s: s["p_name"]),
            " ").alias("sentence"))
    )
