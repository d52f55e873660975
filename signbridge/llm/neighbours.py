"""Nearest neighbours by cosine with multiprobe p-stable hashing.

Method: vectors are scaled to length 1, where the largest cosine is the least Euclidean distance.
Each of ``TABLES`` tables cuts ``HASHES`` Gaussian (2-stable) projections into steps of ``WIDTH``; the
steps of a vector are its bucket. A query visits the occupied buckets of a table in the order
of estimated success, which falls with the squared distances from its projections to the
bucket's steps, until the buckets hold ``SHARE`` of all vectors and at least ``LEAST`` of them. What
all tables find is ranked by the exact cosine in double precision of the original vectors.

How much must be visited depends on the data. With independent random directions, as in the
test tables, the neighbours of a query are hardly nearer than the rest, and a recall above 0.9
takes the share set here (recall 0.94 to 0.97); clustered vectors need a small part of it.

Equal vectors are one class, searched once and listed by their least ids; a bucket of many
vectors is split into blocks that each meet all its queries, which stream past the block. So
neither copies nor a bucket with a third of all vectors gather in one task.

Cases: null, empty and zero vectors and those with null, infinite or NaN components take no
part. Vectors of different lengths are not compared. Rows with a null id take no part. Of rows that
share an id, a query gets each distinct vector's answer; the smaller rank of a candidate counts.
Ties go to the smaller id. With fewer candidates than asked for, all that were found are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signbridge.llm.common import fits, stored

TABLES, HASHES, WIDTH = 4, 4, 1.5
SHARE, LEAST = 0.3, 300
BLOCK = 2048
SEED = 7
_LIMIT, _BITS = 2047, 12


def usable(vector: Column) -> Column:
    ok = F.aggregate(vector, F.lit(True), lambda a, x: a & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok & some, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and offsets of all tables: (tables, dim, hashes) and (tables, hashes)."""
    rng = np.random.default_rng((SEED, dim))
    return rng.standard_normal((TABLES, dim, HASHES)), rng.uniform(0, WIDTH, (TABLES, HASHES))


def steps(vectors: np.ndarray) -> np.ndarray:
    """Projections of unit-length vectors in steps: (tables, rows, hashes)."""
    directions, offsets = projections(vectors.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return (np.einsum("nd,tdm->tnm", unit, directions) + offsets[:, None]) / WIDTH


def packed(cells: np.ndarray) -> np.ndarray:
    """One integer for the steps of a bucket."""
    shifts = np.arange(HASHES, dtype=np.int64) * _BITS
    return ((np.clip(cells, -_LIMIT, _LIMIT).astype(np.int64) + _LIMIT) << shifts).sum(-1)


def unpacked(buckets: np.ndarray) -> np.ndarray:
    shifts = np.arange(HASHES, dtype=np.int64) * _BITS
    return ((buckets[:, None] >> shifts) & ((1 << _BITS) - 1)) - _LIMIT


def index(classes: DataFrame) -> DataFrame:
    """(dim, tab, bucket, id, ids, vector): each class in its bucket of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                buckets = packed(np.floor(steps(matrix(rows.column("vector")))))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([rows.column("dim"), pa.array(np.full(rows.num_rows, t, np.int32)), pa.array(buckets[t]),
                                                      rows.column("id"), rows.column("ids"), rows.column("vector")],
                                                     ["dim", "tab", "bucket", "id", "ids", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    rows = classes.select("dim", "id", "ids", "vector")
    return rows.mapInArrow(run, f"dim int, tab int, bucket long, id long, ids array<long>, vector {kind}")


def probes(queries: DataFrame, occupied: np.ndarray) -> DataFrame:
    """(dim, tab, bucket, query, vector): the buckets that each query visits. ``occupied`` has a row dim, tab,
    bucket, count for each bucket in use; their number is bounded by the steps that unit vectors can take."""
    shared = queries.sparkSession.sparkContext.broadcast(occupied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    rows = batch.filter(pa.array(dims == dim))
                    place = steps(matrix(rows.column("vector")))
                    for t in range(TABLES):
                        mine = known[(known[:, 0] == dim) & (known[:, 1] == t)]
                        if not len(mine):
                            continue
                        low = unpacked(mine[:, 2])
                        gap = np.maximum(0, np.maximum(low - place[t][:, None], place[t][:, None] - low - 1))
                        order = np.argsort((gap ** 2).sum(-1), axis=1, kind="stable")
                        held = np.cumsum(mine[:, 3][order], axis=1)
                        visit = held - mine[:, 3][order] < max(SHARE * mine[:, 3].sum(), LEAST)
                        who, nth = np.nonzero(visit)
                        taken = rows.take(pa.array(who))
                        yield pa.RecordBatch.from_arrays([taken.column("dim"), pa.array(np.full(len(who), t, np.int32)), pa.array(mine[order[who, nth], 2]),
                                                          taken.column("id"), taken.column("vector")], ["dim", "tab", "bucket", "query", "vector"])

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("dim", "id", "vector").mapInArrow(run, f"dim int, tab int, bucket long, query long, vector {kind}")


def ranked(held: DataFrame, asked: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(query, id, score, ids): the k best classes for each query and block of a bucket."""
    blocks = counts.select("dim", "tab", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    if fits(blocks, 32 << 20):
        blocks = F.broadcast(blocks)
    key = ["dim", "tab", "bucket"]
    none = F.lit(None).cast("array<long>")
    left = held.join(blocks, key).select(*key, F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("part"), "id", "ids", "vector")
    right = asked.join(blocks, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("part"),
                                           F.col("query").alias("id"), none.alias("ids"), "vector")
    key = [*key, "block"]
    rows = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, members, unit = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*key, "part")], 1)
            for a, b in zip(c := [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()], [*c[1:], len(keys)], strict=True):
                run_of = batch.slice(a, b - a)
                vectors = matrix(run_of.column("vector"))
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                if tuple(keys[a, :-1]) != now:
                    now, ids, members, unit = tuple(keys[a, :-1]), [], [], []
                if keys[a, -1] == 0:
                    ids.append(run_of.column("id").to_numpy())
                    members += run_of.column("ids").to_pylist()
                    unit.append(vectors)
                    continue
                if not unit:
                    continue
                ids, unit = [np.concatenate(ids)], [np.concatenate(unit)]
                for at in range(0, len(vectors), 512):
                    scores = vectors[at: at + 512] @ unit[0].T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # columns ascend by id
                    who = np.repeat(run_of.column("id").to_numpy()[at: at + 512], best.shape[1])
                    flat = best.ravel()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(who), pa.array(ids[0][flat]), pa.array(np.take_along_axis(scores, best, 1).ravel()),
                        pa.array([members[i] for i in flat.tolist()], pa.list_(pa.int64()))], ["query", "id", "score", "ids"])

    return rows.mapInArrow(run, "query long, id long, score double, ids array<long>")


def search(vectors: DataFrame, asked: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of ``vectors`` where ``asked`` holds, its k nearest others found:
    query_id, rank (from 1), vec_id, score."""
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("dim"),
                       F.coalesce(asked, F.lit(False)).alias("asked"))
    # of equal vectors the k + 1 least ids: enough for any of them to leave itself out
    nth = F.row_number().over(Window.partitionBy("dim", "vector").orderBy("id"))
    least = rows.select("dim", "vector", "id").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = least.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = stored(classes.withColumn("id", F.col("ids")[0]), "vector-classes")
    held = stored(index(classes), "vector-index")
    counts = stored(held.groupBy("dim", "tab", "bucket").count(), "vector-buckets")
    queries = rows.where("asked").select("dim", "vector", F.col("id").alias("query")).distinct()
    queries = queries.join(classes.select("dim", "vector", "id"), ["dim", "vector"])
    queries = stored(queries.select("query", "id", "dim", "vector"), "vector-queries")
    occupied = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 4)  # bounded, see probes()
    found = ranked(held, probes(queries.select("id", "dim", "vector").distinct(), occupied), counts, k + 1)
    found = found.groupBy("query", "id").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))  # met in several tables
    top = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    found = found.withColumn("nth", top).where(F.col("nth") <= k + 1)
    found = found.select(F.col("query").alias("id"), "score", F.explode("ids").alias("vec_id"))
    found = queries.select("query", "id").join(found, "id").where(F.col("vec_id") != F.col("query"))
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(vec_id), "score")
