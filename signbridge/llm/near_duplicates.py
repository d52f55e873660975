"""Near-duplicate documents by the Jaccard similarity of their word-shingle sets.

Method: one hash function; a document keeps the ``k`` least hashes of its shingles (bottom-k
sketch). Inverted lists of the kept values bring documents together, a similarity estimated on
the sketch of the union filters, and the exact similarity of the full sets, taken from the
texts again, decides.

Two documents of similarity 0.8 share about 0.8 k of their kept values, and at least half of
them but for odds of about 8e-7 at k = 48. So a document enters only the lists of its rarest
``s - s // 2 + 1`` kept values, rarity being the same order for all: two documents with half
of their values in common still meet in a list, and values that many unlike documents share
(common passages) bring nobody together. Equal sets are one class and take part once.

A list does not give all its pairs. Documents that meet in lists form families, named by a least
id that is handed on along lists; each is first compared with that one. A family that is then
still in several components is compared in blocks of about ``BLOCK`` documents, a block against
another at a time, without the blocks that are wholly in one component. Pairs that meet in a
list but are in different families and components are compared one by one, by sketch first.
Links inside a component change nothing, so the components are those of all links.

Cases: a null or empty text, or one without words, has an empty set and no links. A null id
takes part in no link (component null, kept). Rows that share an id are one document for the
links. Texts are taken whole; ties do not arise, as the least id names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signbridge.llm.common import SLICE_BYTES, distinct, fits, gathered, stored, text_arrays, text_slices
from signbridge.llm.components import components

#: Kept values of a sketch; documents of a block; slack of the estimate (5 deviations at 0.8).
SKETCH = 48
BLOCK = 256
SLACK = 0.30
#: Ids and pairs are broadcast up to this size, measured before; beyond it they are joined by a shuffle.
MAX_BROADCAST_BYTES = 32 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; those of a usual slice are kept."""
    if len(_powers[0]) >= n:
        return _powers
    tables = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps))
    if n <= SLICE_BYTES:
        _powers[:] = tables
    return tables


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased, cut at space and 0x09-0x0D), and the
    n + 1 word offsets of the texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = (low != 32) & ((low < 9) | (low > 13))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the ascending distinct hashes (signed) of its ``width``-word shingles; with
    fewer words, of the whole sequence."""
    words, at = word_hashes(raw, offsets)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        total += mix(words[i: i + len(total)] ^ factor[i]) * factor[i]
    whole = mix(total).view(np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(distinct(whole[a: b - width + 1]))
        elif b > a:
            short = mix((mix(words[a:b] ^ factor[: b - a]) * factor[: b - a]).sum(dtype=np.uint64, keepdims=True)
                        + np.uint64(b - a))
            out.append(short.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def sketches(docs: DataFrame, width: int, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n (set size), s1 and s2 (a 128-bit name of the set), kept (the k least hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(*text_arrays(batch.column("text")), width)
            names = [(int(s.sum()), int((mix(s.view(np.uint64)) ^ np.uint64(len(s))).view(np.int64).sum())) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                pa.array([s[:k] for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "s1", "s2", "kept"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, kept array<long>")


def _bounded(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    return F.broadcast(df) if fits(df, MAX_BROADCAST_BYTES, F.lit(row_bytes)) else df


def entered_lists(classes: DataFrame) -> DataFrame:
    """(id, values): the lists that a class enters, those of its rarest kept values."""
    posts = classes.select("id", F.size("kept").alias("s"), F.explode("kept").alias("value"))
    counts = posts.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    shared = posts.join(counts, "value")  # a value of one class alone is among the rarest
    shared = shared.groupBy("id", "s").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("v"))
    enter = F.col("s") - F.expr("s div 2") + 1 - (F.col("s") - F.size("v"))
    shared = shared.where(enter > 0).select("id", F.slice("v", 1, enter.cast("int")).alias("v"))
    return shared.select("id", F.array_sort(F.transform("v", lambda x: x["value"])).alias("values"))


def families(lists: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, family): the least id that reaches a class over ``rounds`` lists."""
    rows = lists.select("id", F.explode("values").alias("value"))
    named = rows.withColumn("family", F.col("id"))
    for _ in range(rounds):
        least = named.groupBy("value").agg(F.min("family").alias("family"))
        own = rows.join(least, "value").groupBy("id").agg(F.min("family").alias("family"))
        named = rows.join(own, "id")
    return own


def estimate(a: str, b: str, k: int) -> F.Column:
    """Similarity on the k least values of the union of two sketches."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets, from the texts, have 100 * intersection >= percent * union.

    All pairs of one ``a`` meet, in blocks of about ``BLOCK``; a block holds the set of ``a`` and reads the
    other texts one after another."""
    pairs = gathered(stored(pairs, "pairs")).distinct()
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    blocked = pairs.join(sizes, "a").select("a", "b", "blocks", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = stored(heads.select("a", "block", F.lit(0).alias("part"), F.col("a").alias("id")).unionByName(
        blocked.select("a", "block", F.lit(1).alias("part"), F.col("b").alias("id"))), "wanted")
    texts = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    rows = texts.join(_bounded(wanted), "id").select("a", "block", "part", "id", "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for batch in text_slices(batches):
            left, right = [], []
            sets = shingle_sets(*text_arrays(batch.column("text")), width)
            columns = (batch.column(c).to_pylist() for c in ("a", "block", "part", "id"))
            for a, block, part, b, own in zip(*columns, sets, strict=True):
                if group != (a, block):
                    group, heads = (a, block), []
                if part == 0:
                    heads.append(own)  # more than one where rows share an id
                    continue
                for head in heads:
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    if both and 100 * both >= percent * (len(head) + len(own) - both):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return gathered(stored(rows.mapInArrow(run, "a long, b long"), "verified"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if start == 0 and held and any(held[-1].column(i)[-1].as_py() != int(key[0, i]) for i in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            if stop < len(key):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of the sets (ascending distinct values), as a matrix."""
    m = len(sets)
    out = np.zeros(m * m)
    if not m:
        return out.reshape(0, 0)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    held = np.diff(np.append(first, len(values)))
    for d in range(2, min(m, 24) + 1):  # values of few sets: their pairs one by one
        starts = first[held == d]
        if not len(starts):
            continue
        who = owner[starts[:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                out += np.bincount(who[:, i] * m + who[:, j], minlength=m * m)
    dense = np.flatnonzero(held > 24)
    for k in range(0, len(dense), 4096):  # values of many sets: products of their incidence
        part = dense[k: k + 4096]
        grid = np.zeros((m, len(part)), np.float32)
        lengths = held[part]
        at = np.repeat(first[part] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        grid[owner[at], np.repeat(np.arange(len(part)), lengths)] = 1
        out += np.triu(grid @ grid.T, 1).ravel()
    out = out.reshape(m, m)
    return out + out.T + np.diag([len(s) for s in sets])


def family_links(members: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between different components of a family; ``members`` has id, family, component."""
    parts = members.groupBy("family", "component").agg(F.count("*").alias("c"))
    split = parts.groupBy("family").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("c") <= BLOCK, F.col("c"))).alias("pool"))
    parts = parts.join(split.where("parts > 1"), "family")
    large = F.col("c") > BLOCK  # a large component has blocks of its own
    rows = members.join(parts, ["family", "component"])
    block = F.when(large, F.xxhash64("family", "component", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / BLOCK))))
    block = block.otherwise(F.xxhash64("family", F.lit("pool"), F.pmod(F.xxhash64("component"), F.ceil(F.col("pool") / BLOCK))))
    rows = gathered(stored(rows.select("family", "component", "id", block.alias("block"), F.when(large, F.col("component")).alias("own")), "blocks"))
    blocks = rows.select("family", "block", "own").distinct()
    both = blocks.toDF("family", "x", "own_x").join(blocks.toDF("family", "y", "own_y"), "family")
    both = both.where((F.col("x") <= F.col("y")) & (F.col("own_x").isNull() | F.col("own_y").isNull() | (F.col("own_x") != F.col("own_y"))))
    sides = both.select("family", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    wanted = stored(sides.join(rows, ["family", "block"]).select("x", "y", "component", "id"), "wanted")
    texts = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    grouped = texts.join(_bounded(wanted), "id").select("x", "y", "component", "id", "text")
    grouped = grouped.repartition("x", "y").sortWithinPartitions("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            sets = []
            for part in text_slices(group.to_batches()):
                sets += shingle_sets(*text_arrays(part.column("text")), width)
            ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
            sizes = np.array([len(s) for s in sets])
            both = overlaps(sets)
            linked = (100 * both >= percent * (sizes[:, None] + sizes - both)) & (comp[:, None] < comp) & (both > 0)
            left, right = np.nonzero(linked)
            _, once = np.unique(np.stack([comp[left], comp[right]]), axis=1, return_index=True)  # a link joins two components
            yield pa.RecordBatch.from_arrays([pa.array(ids[left[once]]), pa.array(ids[right[once]])], ["a", "b"])

    return gathered(stored(grouped.mapInArrow(run, "a long, b long"), "family-links"))


def other_pairs(lists: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet in a list, of different families and components, whose sketches allow the similarity."""
    rows = lists.join(members, "id").select("id", "family", "component", F.explode("values").alias("value"))
    many = rows.groupBy("value").agg(F.count("*").alias("c"), F.min("component").alias("p"), F.max("component").alias("q"),
                                     F.min("family").alias("f"), F.max("family").alias("g"))
    many = many.where("p <> q and f <> g").select("value", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(many, "value").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # each pair of blocks meets once
    rows = rows.select("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "family", "component", "id")
    rows = rows.join(classes.select("id", "n", "kept"), "id").join(lists, "id")
    rows = rows.select("value", "i", "j", "own", "family", "component", "id", "n", "kept", "values")
    rows = rows.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            ids, n, comp, family, own = (group.column(c).to_numpy() for c in ("id", "n", "component", "family", "own"))
            maybe = (comp[:, None] != comp) & (family[:, None] < family) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                maybe &= own[:, None] != own
            if not maybe.any():
                continue
            kept, entered = ([x.values.to_numpy() for x in group.column(c)] for c in ("kept", "values"))
            both = overlaps(kept)
            # of the union's sketch: the values up to the least last value; a sketch that is the whole set ends nowhere
            last = np.array([k[-1] if len(k) < size else np.iinfo(np.int64).max for k, size in zip(kept, n, strict=True)])
            within = np.stack([np.searchsorted(k, last, side="right") for k in kept])
            maybe &= 100 * both >= (percent - 100 * SLACK) * (within + within.T - both)
            value = group.column("value")[0].as_py()
            found = [(p, q) for p, q in zip(*np.nonzero(maybe), strict=True)  # a pair counts in the first list in which it meets
                     if np.intersect1d(entered[p], entered[q], assume_unique=True)[0] == value]
            left, right = (ids[[x[side] for x in found]] if found else np.zeros(0, np.int64) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def first_pairs(named: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Each class with the one that names its family, where the estimate on the union's sketch allows it."""
    sketch = classes.select("id", "n", "kept")
    pairs = named.where("id <> family").select(F.col("family").alias("a"), F.col("id").alias("b"))
    pairs = pairs.join(sketch.toDF("b", "nb", "kb"), "b").join(sketch.toDF("a", "na", "ka"), "a")
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return pairs.where(100 * estimate("ka", "kb", k) >= percent - 100 * SLACK).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least id reachable over links), kept."""
    own = stored(sketches(docs, width, k, doc_id, text), "sketches")
    sets = own.where("n > 0 and doc_id is not null")
    classes = stored(sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.first("kept").alias("kept")), "classes")
    lists = stored(entered_lists(classes), "lists")
    named = gathered(stored(families(lists), "families"))
    # rows that share an id link the classes that they are in
    clash = sets.join(classes, ["n", "s1", "s2"]).where(F.col("doc_id") != F.col("id"))
    clash = clash.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    several = sets.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y")
    links = stored(clash.join(several.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b"), "shared-ids")

    def members(comps: DataFrame) -> DataFrame:
        own = named.join(comps.withColumnRenamed("node", "id"), "id", "left")
        return own.select("id", "family", F.coalesce("component", "id").alias("component"))

    def joined(comps: DataFrame, found: DataFrame) -> DataFrame:
        """The components once more links are known: those so far take part as stars."""
        if found.isEmpty():
            return comps
        stars = comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return gathered(components(stars.unionByName(found)))

    links = links.unionByName(verified(first_pairs(named, classes, k, percent), docs, width, percent, doc_id, text))
    comps = gathered(components(links))
    comps = joined(comps, family_links(members(comps), docs, width, percent, doc_id, text))
    comps = joined(comps, verified(other_pairs(lists, classes, members(comps), percent), docs, width, percent, doc_id, text))
    final = classes.join(comps.withColumnRenamed("node", "id"), "id", "left")
    final = final.select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    out = own.join(final, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the least id. Of rows that share a
    kept id the least one stays, compared column by column; rows without id all stay."""
    names = docs.columns
    found = stored(near_duplicates(docs, width, percent, k, doc_id, text).select(F.col(doc_id).alias("_id"), "kept"), "kept")
    known = found.where(F.col("_id").isNotNull())
    dropped = known.where(~F.col("kept")).select("_id").distinct()
    rest = docs.join(_bounded(dropped), docs[doc_id] == dropped["_id"], "left_anti")
    repeated = known.where("kept").groupBy("_id").count().where("count > 1").select("_id")
    if repeated.isEmpty():
        return rest
    single = rest.join(_bounded(repeated), rest[doc_id] == repeated["_id"], "left_anti")
    least = rest.join(_bounded(repeated), rest[doc_id] == repeated["_id"], "left_semi")
    least = least.groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    return single.unionByName(least)
