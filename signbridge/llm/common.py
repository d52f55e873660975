"""What the operators share: tables, written intermediates, held-out rule, Arrow text batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signbridge.session import ensure_checkpoint_dir

#: Text bytes that a task turns into arrays at a time: the memory bound of the numpy operators, whose
#: arrays take some fifty times as much.
SLICE_BYTES = 1 << 18

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let an Arrow batch hold at most ``rows`` rows, unless the session names a number itself: texts are long,
    and each running task holds a batch in the JVM and in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(rows))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs start from the
    files, so a lost executor costs no recomputation of what came before."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a written table up to which its joins and groups are done in one task.
GATHERED_ROWS = 1 << 19


def gathered(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """A written table of few and short rows (counted) in one partition: what is done with such tables alone then
    needs no shuffle, whose price is that of its partitions. A larger table stays as it is."""
    return df.coalesce(1) if df.count() <= (GATHERED_ROWS if max_rows is None else max_rows) else df


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as held out,
    so that nothing is ever learned from it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def least_hashed(ids: DataFrame, groups: list[str], most: Column, doc_id: str = "doc_id") -> DataFrame:
    """Of each group the ``most`` rows (a column of the group's columns) with the least xxhash64 of their id.

    A histogram over the hashes' upper 16 bits says up to which bucket a group's rows are needed; only these
    rows, hardly more than are taken, are ranked. No task sorts a group."""
    hashed = F.xxhash64(doc_id)
    rows = ids.withColumn("_hash", hashed).withColumn("_bucket", F.shiftright("_hash", 48))
    buckets = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    needed = buckets.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most).select(*groups, "_bucket")
    rows = rows.join(F.broadcast(needed), [*groups, "_bucket"], "left_semi")  # 65536 buckets a group at most
    order = Window.partitionBy(*groups).orderBy("_hash", doc_id)
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).select(*ids.columns)


def fits(df: DataFrame, max_bytes: int, row_bytes: Column | None = None) -> bool:
    """Whether ``df``, measured in full, holds at most ``max_bytes``: the check before a broadcast."""
    size = F.sum(row_bytes if row_bytes is not None else F.lit(64))
    return int(df.agg(F.coalesce(size, F.lit(0))).first()[0]) <= max_bytes


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting: much faster for integers than a hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


#: How to free what operators remember in a Python worker between tasks, by name.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remember(name: str, forget: Callable[[], None]) -> None:
    """Register what a worker keeps between tasks; a task of another operator that reads texts frees it."""
    _REMEMBERED[name] = forget


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                max_bytes: int = SLICE_BYTES, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``max_bytes`` of text, or one row. What other
    operators than ``keeps`` remember in this worker is freed first."""
    for name in [n for n in _REMEMBERED if n != keeps]:
        _REMEMBERED.pop(name)()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_arrays(batch.column(column))[1][1:]
        start = 0
        base = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            base = int(ends[stop - 1])
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks, and what its allocators
    keep for themselves is missing on the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n + 1 offsets of the rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def array_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cut a text column so that each part holds at most ``max_bytes``, or one row."""
    for batch in text_slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), max_bytes=max_bytes):
        yield batch.column(0)  # and gives memory back after each Arrow batch
