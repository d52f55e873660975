"""Sinks in the reference's formats. Parquet is the primary stage format; text sinks
are only output formats."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import fixed_decimals
from ..sources.files import PAIR_SEP

# Punctuation and symbol entries appended to the sign corpus.
CORPUS_CONSTANT_LINES = [
    ("unto|until", "M534x515S26506502x485S10010519x485S1001a466x490"),
    ("Full stop|.", "M500x500S38800464x496"),
    ("comma|pause", "M500x500S38700463x496"),
    ("?|question", "M500x500S38900464x493"),
    ("!|exclamation", "M500x500S38810463x495"),
    ("colen|:", "M500x500S38a00464x490"),
]


def pair_lines(df: DataFrame, left: str = "sentence", right: str = "fsw") -> DataFrame:
    return df.select(F.concat(F.col(left), F.lit(PAIR_SEP), F.col(right)).alias("value"))


def write_pair_text(df: DataFrame, path: str, left: str = "sentence", right: str = "fsw",
                    mode: str = "overwrite") -> None:
    """``left# right`` lines (K1)."""
    pair_lines(df, left, right).write.mode(mode).text(path)


def with_corpus_constants(df: DataFrame, word: str = "word", fsw: str = "fsw") -> DataFrame:
    """The sign corpus plus its six constant punctuation entries (K2)."""
    spark = df.sparkSession
    const = spark.createDataFrame(CORPUS_CONSTANT_LINES, f"{word} string, {fsw} string")
    return df.select(word, fsw).unionByName(const)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV without index (K3); ``sep=' '`` and no header gives K7. Quotes inside a field are doubled, and blanks
    around a field are kept."""
    (df.write.mode(mode).option("header", header).option("sep", sep).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Stage tables (K4): Parquet by default, JSON lines keep non-ASCII text as is."""
    df.write.mode(mode).format(fmt).save(path)


def write_entries(chunks: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Vocabulary entries in the format's form (K4), one row an entry; its lists meet only here."""
    from ..operators.vocab import lists_of_chunks
    write_table(lists_of_chunks(chunks), path, fmt, mode)


def write_line_aligned(df: DataFrame, path: str, columns: list[str], order_col: str = "row_id") -> None:
    """Many line-aligned outputs (K5) as ONE wide table: line n of every column is row n.

    Parquet keeps the alignment by construction; use ``write_column_lines`` for text."""
    df.select(order_col, *columns).write.mode("overwrite").parquet(path)


def write_column_lines(df: DataFrame, path: str, column: str, order_col: str = "row_id") -> None:
    """One column as text lines in ``order_col`` order (range-partitioned, sorted)."""
    df.repartitionByRange(order_col).sortWithinPartitions(order_col) \
      .select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def metric_report(scored: DataFrame, order_col: str = "row_id", digits: int = 4) -> DataFrame:
    """Per-row report (K6): Row (1-based), Precision, Recall, F1 as fixed-decimal text."""
    return scored.select((F.col(order_col) + 1).alias("Row"),
                         fixed_decimals("precision", digits).alias("Precision"),
                         fixed_decimals("recall", digits).alias("Recall"),
                         fixed_decimals("f1", digits).alias("F1"))


def mean_line(scored: DataFrame) -> DataFrame:
    """The last line of the F1 report (K6)."""
    return scored.agg(F.concat(F.lit("Mean F1: "), F.avg("f1").cast("string")).alias("value"))


def distance_block(distance: DataFrame) -> DataFrame:
    """The distance report (K6) as text lines (``ordered``, ``line``, ``value``): a block for symbols as written
    and one for sorted symbols; append the second to the first with ``mode='append'``."""
    head = F.when(F.col("ordered"), F.lit("======ORDERED FACTOR======")).otherwise(F.lit("======NOT ORDERED FACTOR======"))
    part = lambda axis: [F.lit(f"{axis.upper()} coordinates:"), F.concat(F.lit("total distance: "), F.col(f"total_{axis}").cast("string")),
                         F.concat(F.lit("token number: "), F.col("tokens").cast("string")),
                         F.concat(F.lit("mean distance: "), F.col(f"mean_{axis}").cast("string")), F.lit("")]
    lines = F.array(head, F.lit(""), *part("x"), *part("y"))
    return distance.select("ordered", F.posexplode(lines).alias("line", "value"))


def line_report(per_line: DataFrame, order_col: str = "row_id") -> DataFrame:
    """The per-line report (K6): line number, gold, prediction, BLEU and chrF with two decimals."""
    return per_line.select(order_col, F.concat(
        F.lit("Line "), F.col(order_col).cast("string"), F.lit(":\nGold: "), F.col("ref"), F.lit("\nPred: "), F.col("hyp"),
        F.lit("\nBLEU: "), fixed_decimals("bleu", 2), F.lit("\nchrF: "), fixed_decimals("chrf", 2), F.lit("\n")).alias("value"))


#: A stage's commit record: what was built, from what, and where it lies.
COMMIT = "made timestamp, data string, sources string, params string, rows long, schema string"


def _sources(spark: SparkSession, inputs: Sequence[str]) -> str:
    """The files below ``inputs`` in short: how many there are, and a sum over hashes of path, length and time."""
    if not inputs:
        return ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs)).select("path", "length", "modificationTime")
    return "{} {}".format(*files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def build_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet",
                inputs: Sequence[str] = (), params: Mapping[str, object] | None = None) -> DataFrame:
    """A stage (K8): the table that ``build`` makes is written once below ``path`` and read back from then on.

    The table goes to a fresh folder; a commit record (sources, parameters, rows, schema) is appended
    to ``<path>/commits`` when it is written in full. A build that died leaves a folder that no record names, and
    the next call builds again; so does one whose input files or parameters have changed. Folders
    of earlier builds stay for those who still read them. Whether a record exists is asked of the store that
    Spark reads; of two builders at a time both finish, and the later record holds."""
    sources, wanted = _sources(spark, inputs), json.dumps(dict(params or {}), sort_keys=True, default=str)

    def committed() -> DataFrame | None:
        commits = _commits(spark, path)
        known = commits and commits.where((F.col("sources") == sources) & (F.col("params") == wanted)).orderBy(F.desc("made"), "data").first()
        if not known:
            return None
        return spark.read.format(fmt).schema(StructType.fromJson(json.loads(known["schema"]))).load(f"{path}/{known['data']}")

    found = committed()
    if found is not None:
        return found
    out, data = build(), f"data-{uuid.uuid4().hex}"
    counted = Observation()
    out.observe(counted, F.count(F.lit(1)).alias("rows")).write.format(fmt).save(f"{path}/{data}")
    # what a format can't keep (a column that may not be null) is not asked of it
    schema = spark.read.format(fmt).schema(out.schema).load(f"{path}/{data}").schema
    record = [(data, sources, wanted, counted.get["rows"], schema.json())]
    record = spark.createDataFrame(record, "data string, sources string, params string, rows long, schema string")
    record.select(F.current_timestamp().alias("made"), "*").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return committed()


def build_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet") -> DataFrame:
    """Stage reuse (K8) whatever the inputs: ``build`` is called only if ``path`` has no whole table yet."""
    return build_stage(spark, path, build, fmt)
