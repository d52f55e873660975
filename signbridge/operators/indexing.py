"""Row numbering and exact hash-ranked cuts without a single-partition window.

* ``dense_index``: consecutive 0-based numbers in a sort order (a distributed
  ``zipWithIndex``): range-partition + sort, number rows inside each partition, add the
  per-partition offsets (a table with one row per partition).
* ``hash_rank_cut``: the exact "first n rows ordered by md5(id:seed), id" contract
  used by seeded samples and splits. It buckets rows by the leading bits of the hash,
  counts the buckets, and ranks rows only inside the (few) buckets that straddle a cut
  point, so the bulk of the data is filtered without any shuffle or global sort.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, default_parallelism

# Leading hex digits of the hash used for the bucket histogram: 2^20 buckets, or 2^16
# per group when rows are cut per group (the broadcast histogram stays near 1M rows for
# up to ~16 groups).
HASH_BUCKET_HEX = 5
HASH_BUCKET_HEX_GROUPED = 4


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order.

    ``order_cols`` must give a total order (append an id to break ties). The sorted,
    locally numbered frame is checkpointed so the offsets and the rows agree even if
    tasks are re-run.
    """
    n = num_partitions or default_parallelism(df.sparkSession)
    # the input is read twice (range-bound sampling, then the shuffle): compute it once
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    ranged = (src.repartitionByRange(n, *order_cols)
                 .sortWithinPartitions(*order_cols)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = checkpoint(ranged)
    src.unpersist()
    # monotonically_increasing_id = (partition index << 33) + row number in partition
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    # one row per partition: a proven small side
    out = ranged.join(F.broadcast(offsets), "_pid", "left")
    return out.withColumn(name, (F.coalesce(F.col("_off"), F.lit(0)) + local).cast("bigint")) \
              .drop("_pid", "_mono", "_off")


def seeded_hash(id_col: Column, seed: Column | int | str) -> Column:
    """md5 hex of ``<id>:<seed>`` (the portable sampling order); null for a null id (see ``id_text``)."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(id_col.cast("string"), F.lit(":"), seed_c.cast("string")))


def id_text(df: DataFrame, id_col: str) -> Column:
    """The id as text; for a null id one from the hash of the row's columns, so that rows without id are not
    lost and don't all fall into one place (rows that are alike in all columns do)."""
    plain = [F.col(f.name) for f in df.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.xxhash64(*plain).cast("string")))


def hash_rank_cut(df: DataFrame, id_col: str, seed: int | str | Column, cuts: list[Column | int],
                  group_cols: list[str] | None = None, name: str = "part") -> DataFrame:
    """Label rows by how many cut points their hash rank reaches.

    Rows are ranked (0-based) by ``(md5(id:seed), id)`` within ``group_cols``; a row
    gets ``name`` = number of cuts ``c`` with ``rank >= c``. With cuts ``[n]`` part 0 is
    exactly the first ``n`` rows. A null id is an id like others (``id_text``). Cuts may be columns computed from group totals
    (``_total`` is available).
    """
    groups = list(group_cols or [])
    own = {n: fresh_name(df, n) for n in ("_h", "_b", "_bn", "_hi", "_lo", "_straddle", "_rank")}  # columns of the input keep their names
    total = "_total"
    cut = [fresh_name(df, f"_c{i}") for i in range(len(cuts))]
    held = fresh_name(df, "_held_total") if total in df.columns else None
    if held:  # the cuts read ``_total``: an input column of that name steps aside
        df = df.withColumnRenamed(total, held)
    seed_c = F.col(seed) if isinstance(seed, str) and seed in df.columns else seed
    h = seeded_hash(id_text(df, id_col), seed_c)
    digits = HASH_BUCKET_HEX_GROUPED if groups else HASH_BUCKET_HEX
    with_h = df.withColumn(own["_h"], h).withColumn(own["_b"], F.substring(F.col(own["_h"]), 1, digits))

    hist = with_h.groupBy(*groups, own["_b"]).agg(F.count(F.lit(1)).alias(own["_bn"]))
    wcum = Window.partitionBy(*groups).orderBy(own["_b"]) if groups else Window.orderBy(own["_b"])
    hist = (hist
            .withColumn(own["_hi"], F.sum(own["_bn"]).over(wcum.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_total", F.sum(own["_bn"]).over(
                (Window.partitionBy(*groups) if groups else Window.partitionBy())))
            .withColumn(own["_lo"], F.col(own["_hi"]) - F.col(own["_bn"])))
    cut_cols = [c if isinstance(c, Column) else F.lit(c) for c in cuts]
    for i, c in enumerate(cut_cols):
        hist = hist.withColumn(cut[i], c.cast("bigint"))
    # a bucket straddles cut c when lo < c < hi: only its rows need an exact rank
    straddle = F.lit(False)
    for i in range(len(cut_cols)):
        straddle = straddle | ((F.col(own["_lo"]) < F.col(cut[i])) & (F.col(cut[i]) < F.col(own["_hi"])))
    hist = hist.withColumn(own["_straddle"], straddle)

    # the histogram has at most groups x 16^digits rows
    joined = with_h.join(F.broadcast(hist), [*groups, own["_b"]])
    inner = joined.where(~F.col(own["_straddle"])).withColumn(own["_rank"], F.col(own["_lo"]))
    edge = joined.where(F.col(own["_straddle"]))
    wb = Window.partitionBy(*groups, own["_b"]).orderBy(own["_h"], id_col)
    edge = edge.withColumn(own["_rank"], F.col(own["_lo"]) + F.row_number().over(wb) - 1)
    ranked = inner.unionByName(edge)
    label = F.lit(0)
    for i in range(len(cut_cols)):
        label = label + F.when(F.col(own["_rank"]) >= F.col(cut[i]), 1).otherwise(0)
    out = ranked.withColumn(name, label.cast("int")).drop(*own.values(), total, *cut)
    return out.withColumnRenamed(held, total) if held else out


def hash_rank(df: DataFrame, id_col: str, seed: int | str, name: str = "rank") -> DataFrame:
    """Exact 0-based rank of every row by ``(md5(id:seed), id)`` (a full seeded shuffle).

    Buckets are ranges of a uniform hash, so the window work spreads evenly.
    """
    hashed, bucket, count, low = (fresh_name(df, n) for n in ("_h", "_b", "_bn", "_lo"))
    with_h = df.withColumn(hashed, seeded_hash(id_text(df, id_col), seed)).withColumn(bucket, F.substring(F.col(hashed), 1, HASH_BUCKET_HEX))
    hist = with_h.groupBy(bucket).agg(F.count(F.lit(1)).alias(count))
    hist = hist.withColumn(low, F.coalesce(F.sum(count).over(
        Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = with_h.join(F.broadcast(hist.select(bucket, low)), bucket)
    wb = Window.partitionBy(bucket).orderBy(hashed, id_col)
    return joined.withColumn(name, (F.col(low) + F.row_number().over(wb) - 1).cast("bigint")).drop(hashed, bucket, low)
