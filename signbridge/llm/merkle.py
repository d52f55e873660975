"""Merkle manifest of a dataset: a tree of hashes for each part, their roots under one root, and proofs.

Method: checkpoint and recompute. The nodes of a tree are written only every ``STEP`` levels, the
leaves among them. A stored level is held in aligned subtrees of ``2 ** STEP`` nodes, one row
each; hashing a subtree up gives one node of the next stored level. For proofs the
missing interior nodes of a subtree are made again from its stored nodes, the siblings on the way
up are emitted, and the nodes dropped; from the top level downwards, so that a subtree only
appends the siblings that its own root has.

H is the lowercase hex sha256 of its inputs one after another, digests as hex text. Every two
consecutive nodes of a level become their H, a last one alone becomes the H of itself, until one
node remains; a lone leaf is its own root. Parts are ordered by name, null first, then bytewise.

No task holds more than a subtree, however many leaves a part has: leaves are numbered over
ranges of (part, id), so that one part may hold all rows. Leaves of a part ascend by id, null
ids first, those with equal ids by their hash; rows that are alike in all take neighbouring places,
and it makes no difference which. An empty table gives an empty manifest. Very long texts are
hashed whole, in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signbridge.llm.common import fits, stored
from signbridge.session import default_parallelism

#: Levels from one stored level to the next.
STEP = 8
#: Roots of parts and tables of offsets are broadcast up to this size, measured before.
MAX_BROADCAST_BYTES = 32 << 20
_DIGEST = 64


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, MAX_BROADCAST_BYTES, F.lit(256)) else df


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``part``) with ``pos``, the place in the part by ``order``, and ``n``, the rows of the part. Ranges
    over part and order make the partitions, so that a large part is spread over many."""
    spark = rows.sparkSession
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # rows that are alike are spread, too
    keys = ["part", *order, "_tie"]
    ranged = tied.repartitionByRange(default_parallelism(spark), *keys).sortWithinPartitions(*keys).drop("_tie")
    ranged = ranged.withColumn("_task", F.spark_partition_id())
    ranged = ranged.withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_task").cast("long"), 33))
    ranged = stored(ranged, "ranges")
    counts = ranged.groupBy("part", "_task").agg(F.count("*").alias("_c"), F.min("_row").alias("_first"))
    before = F.sum("_c").over(Window.partitionBy("part").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_c").over(Window.partitionBy("part")).alias("n"))
    counts = _broadcast_if_small(stored(counts, "offsets"))
    out = ranged.join(counts, ["part", "_task"]).withColumn("pos", F.col("_row") + F.col("_shift"))
    return out.drop("_task", "_row", "_shift")


def subtrees(nodes: DataFrame, step: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """A stored level: (part, tree, n, nodes), ``nodes`` being the structs (pos, node, extra...) of ``2 ** step`` places."""
    grouped = nodes.groupBy("part", "n", F.shiftright("pos", step).alias("tree"))
    return stored(grouped.agg(F.array_sort(F.collect_list(F.struct("pos", "node", *extra))).alias("nodes")), "level")


def _up(nodes: list[str], n: int, step: int) -> Iterator[list[str]]:
    """The levels of a subtree, from its stored nodes to its root; ``n`` is the number of nodes of the whole level."""
    yield nodes
    for _ in range(min(step, (n - 1).bit_length())):
        nodes = [h("".join(nodes[i: i + 2])) for i in range(0, len(nodes), 2)]
        yield nodes


def _batches(rows: Iterator[pa.RecordBatch], make: Callable[..., tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each row of each batch the columns that ``make`` gives, as lists."""
    for batch in rows:
        for k in range(0, batch.num_rows, 16):
            columns: list[list] = [[] for _ in schema]
            part = batch.slice(k, 16)
            names = part.schema.names
            for row in zip(*(part.column(i).to_pylist() for i in range(len(names))), strict=True):
                for held, new in zip(columns, make(**dict(zip(names, row, strict=True))), strict=True):
                    held += new
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def next_level(level: DataFrame, step: int) -> DataFrame:
    """(part, pos, n, node): the roots of the subtrees of a stored level."""
    schema = pa.schema([("part", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(part: str, tree: int, n: int, nodes: list) -> tuple:
            *_, top = _up(nodes, n, step)
            return [part], [tree], [max(1, -(-n >> step))], top
        yield from _batches(batches, make, schema)

    rows = level.select("part", "tree", "n", F.transform("nodes", lambda x: x["node"]).alias("nodes"))
    return rows.mapInArrow(run, "part string, pos long, n long, node string")


class Forest:
    """The stored levels of the trees of all parts. ``nodes`` has part (a string that is not null), node, the
    columns of ``order`` and ``extra``, which stay with the leaves."""

    def __init__(self, nodes: DataFrame, order: list[str], extra: tuple[str, ...] = (), step: int = STEP) -> None:
        self.step, self.extra = step, extra
        self.levels = [subtrees(numbered(nodes, order), step, extra)]
        tops = []
        while True:
            above = stored(next_level(self.levels[-1], step), "nodes")
            tops.append(above.where("n = 1").select("part", "node"))
            rest = above.where("n > 1")
            if rest.isEmpty():
                break
            self.levels.append(subtrees(rest, step))
        self.roots = tops[0]
        for more in tops[1:]:
            self.roots = self.roots.unionByName(more)

    def _ways(self, level: DataFrame, above: DataFrame | None, names: tuple[str, ...]) -> DataFrame:
        """Per node of a level: part, pos, n, the struct fields ``names``, and way, the siblings up to the root of the
        part, one after another. ``above`` has the ways of the next level's nodes."""
        step = self.step
        fields = level.select("part", "tree", "n", "nodes")
        if above is not None:
            fields = fields.join(above.select("part", F.col("pos").alias("tree"), F.col("way").alias("rest")), ["part", "tree"], "left")
        else:
            fields = fields.withColumn("rest", F.lit(None).cast("string"))
        kinds = {f.name: f.dataType.simpleString() for f in level.schema["nodes"].dataType.elementType.fields}
        arrow = {"string": pa.string(), "bigint": pa.int64()}
        schema = pa.schema([("part", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("way", pa.string()),
                            *((x, arrow[kinds[x]]) for x in names)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def make(part: str, tree: int, n: int, nodes: list, rest: str | None) -> tuple:
                ways = [rest or ""]
                for nodes_of in reversed(list(_up([x["node"] for x in nodes], n, step))[:-1]):
                    ways = [(nodes_of[i ^ 1] if i ^ 1 < len(nodes_of) else "") + ways[i >> 1] for i in range(len(nodes_of))]
                return ([part] * len(nodes), [x["pos"] for x in nodes], [n] * len(nodes), ways,
                        *([x[name] for x in nodes] for name in names))
            yield from _batches(batches, make, schema)

        return fields.mapInArrow(run, "part string, pos long, n long, way string" + "".join(f", {x} {kinds[x]}" for x in names))

    def proofs(self) -> DataFrame:
        """Per leaf: part, pos, n, way (the siblings, left or right by ``pos``, up to the root of the part), node and extra."""
        above = None
        for level in reversed(self.levels[1:]):
            above = stored(self._ways(level, above, ()), "ways")
        return self._ways(self.levels[0], above, ("node", *self.extra))


def fold(node: str, pos: int, n: int, way: str) -> str:
    """The root that a node at place ``pos`` of ``n`` gives with the siblings of ``way``."""
    at = 0
    while n > 1:
        sibling = ""
        if pos ^ 1 < n:
            sibling, at = way[at: at + _DIGEST], at + _DIGEST
        node = h(sibling + node if pos & 1 else node + sibling)
        pos, n = pos >> 1, n + 1 >> 1
    return node


def manifest(rows: DataFrame, claimed: str | None = None, step: int = STEP) -> DataFrame:
    """Manifest and checked proofs of a table of leaves: ``id``, ``part`` (nullable), ``leaf`` and, if ``claimed``
    names it, a column with the leaf that is to be verified in place of the own one.

    Per row: id, part, leaf, subroot, root, proof (the siblings from the leaf to the root), folded_root, verified."""
    tested = F.coalesce(F.col(claimed), F.col("leaf")) if claimed else F.col("leaf")
    named = rows.select("id", F.coalesce(F.concat(F.lit("="), F.col("part").cast("string")), F.lit("")).alias("part"),
                        F.col("leaf").alias("node"), tested.alias("tested"))
    parts = Forest(stored(named, "leaves"), ["id", "node"], ("id", "tested"), step)
    subroots = stored(parts.roots, "subroots")
    top = Forest(subroots.select(F.lit("").alias("part"), "node", F.col("part").alias("name")), ["name"], ("name",), step)
    root = top.roots.first()
    root = root["node"] if root else ""
    above = top.proofs().select(F.col("name").alias("part"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"),
                                F.col("way").alias("top_way"), F.col("node").alias("subroot"))
    above = _broadcast_if_small(stored(above, "top-ways"))
    proofs = parts.proofs().join(above, "part")

    @F.arrow_udf("string")
    def climb(node: pa.Array, pos: pa.Array, n: pa.Array, way: pa.Array, top_pos: pa.Array, top_n: pa.Array, top_way: pa.Array) -> pa.Array:
        columns = [x.to_pylist() for x in (node, pos, n, way, top_pos, top_n, top_way)]
        return pa.array([fold(fold(leaf, *own), *rest) for leaf, *both in zip(*columns, strict=True)
                         for own, rest in [(both[:3], both[3:])]], pa.string())

    out = proofs.withColumn("folded_root", climb("tested", "pos", "n", "way", "top_pos", "top_n", "top_way"))
    part = F.when(F.col("part") != "", F.substring("part", 2, 2**31 - 1))
    return out.select("id", part.alias("part"), F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"),
                      F.concat("way", "top_way").alias("proof"), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def documents_manifest(docs: DataFrame, tampered: Column | None = None, step: int = STEP) -> DataFrame:
    """The manifest of ``documents`` by language: leaves hash doc_id, source, lang, n_chars and text. Rows for which
    ``tampered`` is true are verified with one character more in ``n_chars``."""
    own = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = [docs["doc_id"].cast("long").alias("id"), docs["lang"].cast("string").alias("part"), row_hash(*own).alias("leaf")]
    if tampered is None:
        return manifest(docs.select(*rows), None, step)
    changed = [*own[:3], docs["n_chars"] + 1, own[4]]
    return manifest(docs.select(*rows, F.when(tampered, row_hash(*changed)).alias("claimed")), "claimed", step)
