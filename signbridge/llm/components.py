"""Connected components of a link table, by alternating stars over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signbridge.llm import common
from signbridge.llm.common import stored


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with v < u. Large star: u's larger neighbours get its least neighbour (or u);
    small star: u and its smaller neighbours get the least of them."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _in_one_task(links: DataFrame) -> DataFrame:
    """The components of a link table of bounded size (one partition): every root takes the least root next to it,
    and paths are halved, until nothing changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        ends = np.stack([np.concatenate(side) for side in zip(*held, strict=True)])
        nodes, at = np.unique(ends, return_inverse=True)  # places ascend as the ids do
        u, v = at.reshape(ends.shape)
        root = np.arange(len(nodes))
        while True:
            least = np.minimum(root[u], root[v])
            now = root.copy()
            np.minimum.at(now, root[u], least)
            np.minimum.at(now, root[v], least)
            while (now[now] != now).any():
                now = now[now]
            if (now == root).all():
                break
            root = now
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node with a link; a component is named by its least node.

    A link table of few rows (counted) is worked off in one task. A larger one shrinks to stars in a number of rounds that grows with the logarithm of the
    longest path; each round is written to the shared folder. Minima are pre-aggregated, and
    joins on a hub are ones that adaptive execution can split. No links give no rows; links of
    a node with itself, repeated links and links with a null end are ignored."""
    links = links.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    links = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    links = links.where(F.col("u") != F.col("v"))
    now = stored(links, "links")
    if now.count() <= common.GATHERED_ROWS:
        return stored(_in_one_task(now.select(F.col("u").cast("long"), F.col("v").cast("long"))), "components")
    now = stored(now.distinct(), "links")
    while True:
        # u has v and nothing else, and v is no u: the table is made of stars
        count, sources = now.agg(F.count("*"), F.countDistinct("u")).first()
        if count == sources:
            if now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
                return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                    now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = stored(_starred(_starred(now, large=True), large=False), "links")
