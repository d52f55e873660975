"""Embeddings stored by the hash of their text: no text is embedded twice by one model.

The store is an append-only Parquet table (``text_hash``, ``embedding``) partitioned by ``model``. A run that dies
may leave some of its files; they hold whole rows, which the next run finds. Two runs at a time may both embed a
text; readers take one of its rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import EmbedFn, embed_column
from .indexing import fresh_name

STORE = "text_hash string, embedding array<float>, model string"


def stored_embeddings(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The rows of ``model``: ``text_hash``, ``embedding``, each hash once; none where there is no store yet."""
    try:
        rows = spark.read.schema(STORE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORE)
    return rows.where(F.col("model") == model).groupBy("text_hash").agg(F.first("embedding").alias("embedding"))


def store_embeddings(texts: DataFrame, text_col: str, path: str, model: str, fn: EmbedFn | None = None) -> None:
    """Embed those texts that the store doesn't hold for ``model``, each distinct one once, and append them."""
    spark = texts.sparkSession
    wanted = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct() \
                  .withColumn("text_hash", F.sha2("text", 256))
    new = wanted.join(stored_embeddings(spark, path, model).select("text_hash"), "text_hash", "left_anti")
    vectors = embed_column(new, "text", fn, "embedding", dedupe=False)
    vectors.select("text_hash", "embedding", F.lit(model).alias("model")).write.mode("append").partitionBy("model").parquet(path)


def embed_stored(df: DataFrame, text_col: str, path: str, model: str, fn: EmbedFn | None = None,
                 out_col: str = "embedding") -> DataFrame:
    """``embed_column`` through the store: add ``out_col``, embedding only texts that are new to it. A null text has a
    null vector."""
    store_embeddings(df, text_col, path, model, fn)
    key = fresh_name(df, "text_hash")
    vectors = stored_embeddings(df.sparkSession, path, model).select(F.col("text_hash").alias(key), F.col("embedding").alias(out_col))
    return df.withColumn(key, F.sha2(F.col(text_col), 256)).join(vectors, key, "left").drop(key)
