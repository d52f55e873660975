"""File sources in the reference's formats, read with explicit schemas.

Every reader adds a ``row_id`` so order-dependent operators (first-wins dedupe,
positional joins) never rely on Spark's row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.indexing import dense_index

# Fixed value: separator between the two sides of a pair line (``left# right``).
PAIR_SEP = "# "

SIGNBANK_SCHEMA = T.StructType([
    T.StructField("spoken_language", T.StringType()),
    T.StructField("sign_language", T.StringType()),
    T.StructField("Sentence/Sign", T.StringType()),
    T.StructField("annotated_texts_multilingual", T.StringType()),
    T.StructField("sign_writing", T.StringType()),
])

VOCABULARY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("word", T.ArrayType(T.StringType())),
    T.StructField("fsw", T.ArrayType(T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def with_line_numbers(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive 0-based line numbers in file order (file path, then offset order)."""
    ordered = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_mono", F.monotonically_increasing_id())
    return dense_index(ordered, ["_file", "_mono"], name).drop("_file", "_mono")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, sep: str = ",") -> DataFrame:
    """CSV with header, quoted multi-line fields (S1) and consecutive ``row_id``, as line files have.
    An empty field, quoted or not, is null: the format does not tell them apart."""
    df = (spark.read.schema(schema).option("header", header).option("multiLine", True)
          .option("escape", '"').option("sep", sep).csv(path))
    return with_line_numbers(df)


def read_lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """One row per line, blank lines kept, with consecutive ``row_id`` (S4)."""
    df = spark.read.text(path).withColumnRenamed("value", name)
    return with_line_numbers(df)


def read_pair_text(spark: SparkSession, path: str, left: str = "sentence", right: str = "fsw",
                   dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """``left# right`` lines (S2) -> (pairs, corrupt lines).

    Split at the last ``# `` (sign strings never contain it), so a left side may itself
    contain ``# ``; quotes are ordinary characters. Lines without the separator go to the
    second frame instead of failing the whole load. ``dedupe`` keeps the first copy of
    each distinct pair (by ``row_id``).
    """
    lines = read_lines(spark, path, "value")
    has_sep = F.col("value").contains(PAIR_SEP)
    pairs = lines.where(has_sep).select(
        "row_id",
        F.regexp_extract("value", r"(?s)\A(.*)# (.*)\z", 1).alias(left),
        F.regexp_extract("value", r"(?s)\A(.*)# (.*)\z", 2).alias(right))
    corrupt = lines.where(~has_sep)
    if dedupe:
        pairs = pairs.groupBy(left, right).agg(F.min("row_id").alias("row_id"))
    return pairs, corrupt


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = VOCABULARY_SCHEMA) -> DataFrame:
    """A JSON array of objects (S3), e.g. the vocabulary with embeddings."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def inline_sequences(spark: SparkSession, fsw_seqs: list[str]) -> DataFrame:
    """Ad-hoc sign sequences as a table (S5): (seq_id, fsw)."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(fsw_seqs)], "seq_id long, fsw string")
