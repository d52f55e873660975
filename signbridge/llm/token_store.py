"""Token ids in binary shards, with constant-time access by document key.

Format: a folder with three tables in Parquet, which Spark writes, commits and reads on any store.

* ``payload``: (shard, chunk, n_ids, ids). ``ids`` holds raw little-endian unsigned integers, 16
  bits wide where the vocabulary allows, else 32, of consecutive documents; shards, chunks
  within a shard and documents within a chunk ascend by key. ``keys`` and ``counts`` beside it
  name the chunk's documents in order.
* ``shards``: (shard, first): how many ids come before the shard.
* ``index``: (bucket, n, levels, marks, shard, chunk, start, length): a minimal perfect hash
  (``perfect_hash``) of the bucket's keys with, in the order of its places, their stored
  fingerprints and where their ids are: shard, chunk, offset within the shard, number of ids.

A key is found by its bucket, the levels of that bucket and one comparison of fingerprints.
Buckets are of bounded size, whatever the number of documents, and are built each by one task.

Texts are encoded whole with the tokenizers library; null is empty, and every document ends
with ``end_id``. Documents without key (null) come first, under a key of their own. Rows that
share a key are all stored, one after another in the order of their texts; the index leads to
the first and holds the ids of all. Other columns are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from signbridge.llm import perfect_hash
from signbridge.llm.common import fits, remember, scratch_path, text_slices

#: Ids of a chunk at most, unless a document alone has more; keys of an index bucket on average.
CHUNK_IDS = 1 << 18
BUCKET_KEYS = 4096
#: Distinct pieces that a worker remembers with their ids.
MEMO = 450_000
#: Pieces that byte-level pre-tokenization surely divides: words of plain letters, ASCII digits, runs of
#: ASCII signs but the apostrophe (each with the space before it), single line ends.
_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n")

INDEX = "bucket long, n int, levels binary, marks binary, shards binary, chunks binary, starts binary, lengths binary"


class Pieces(dict):
    """Raw ids of pieces; a piece that isn't there yet is encoded by the library's model."""

    def __init__(self, tokenizer: Tokenizer, dtype: np.dtype) -> None:
        self.encode, self.dtype = tokenizer.model.tokenize, dtype
        # the library's characters for bytes, learned from the library
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = str.maketrans({c: shown(c)[0][0] for c in map(chr, [*range(128), *range(0xC0, 0x100)])})

    def __missing__(self, piece: str) -> bytes:
        ids = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.encode(piece.translate(self.shown))])
        if sys.byteorder != "little":
            ids.byteswap()
        self[piece] = made = ids.tobytes()
        return made


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer file, as the library gives them.

    A text that ``_PIECE`` covers in full is put together from its pieces, which the library's
    model encodes once for a worker, each by itself, as it does within a text. Any other text
    goes to the library as it is, and so do texts that hold one of the file's added tokens (such as an
    end mark): the library's default finds these in the text and gives their own ids."""

    def __init__(self, tokenizer_file: str) -> None:
        self.tokenizer = Tokenizer.from_str(tokenizer_file)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = Pieces(self.tokenizer, self.dtype)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:  # long pieces are mostly rare ones
            for p in [p for p in self.memo if len(p) > 8]:
                del self.memo[p]
            if len(self.memo) > MEMO // 2:
                self.memo.clear()
        out: list[bytes] = [b""] * len(texts)
        whole = []
        get, find = self.memo.__getitem__, _PIECE.findall
        for i, text in enumerate(texts):
            pieces = find(text)
            if sum(map(len, pieces)) != len(text) or "\n\n" in text or any(m in text for m in self.marks):
                whole.append(i)
            else:
                out[i] = b"".join(map(get, pieces))
        for i, made in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(made.ids, self.dtype).tobytes()
        return out


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def encoder(tokenizer_file: str) -> Encoder:
    """One encoder for all tasks of a Python worker, until it does other work."""
    remember("token_store", _encoder.cache_clear)
    return _encoder(tokenizer_file)


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Write the three tables of ``docs`` below ``path``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_file)
    dtype = Encoder(tokenizer_file).dtype

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        end = np.array([end_id], coder.dtype).tobytes()
        shard, chunk = TaskContext.get().partitionId(), 0
        keys, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            counts = [len(x) // coder.dtype.itemsize for x in ids]
            row = {"shard": [shard], "chunk": [chunk], "n_ids": [sum(counts)], "keys": [keys], "counts": [counts], "ids": [b"".join(ids)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())),
                ("counts", pa.list_(pa.int64())), ("ids", pa.binary())]))

        for batch in text_slices(batches, max_bytes=1 << 20, keeps="token_store"):
            coded = coder.encode(batch.column("text").fill_null("").to_pylist())
            for k, x in zip(batch.column("key").to_pylist(), coded, strict=True):
                if ids and size + len(x) > CHUNK_IDS * coder.dtype.itemsize:
                    yield flush()
                    chunk, keys, ids, size = chunk + 1, [], [], 0
                keys.append(k)
                ids.append(x + end)
                size += len(x) + len(end)
        if ids:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # rows of one key may be many: they are dealt by their texts and by where they come from, too
    order = ["key", F.xxhash64("text"), F.pmod(F.monotonically_increasing_id(), F.lit(1024))]
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    packed = rows.mapInArrow(pack, "shard int, chunk int, n_ids long, keys array<long>, counts array<long>, ids binary")
    packed.write.option("compression", "none").parquet(f"{path}/payload")

    chunks = spark.read.parquet(f"{path}/payload").select("shard", "chunk", "n_ids", "keys", "counts")
    sums = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    firsts = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(sums), F.lit(0)))
    firsts.select("shard", "first").write.parquet(f"{path}/shards")

    entries = _entries(spark, path)
    known = entries.groupBy("key").agg(F.min(F.struct("shard", "start", "chunk")).alias("f"), F.sum("length").alias("length"))
    number = known.count()
    buckets = max(1, -(-number // BUCKET_KEYS))
    known = known.select(_bucket(buckets), "key", "f.shard", "f.chunk", "f.start", "length")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_bucket(batches):
            keys = group.column("key").fill_null(0).to_numpy().view(np.uint64)
            levels = perfect_hash.build(keys)
            order = np.argsort(perfect_hash.places(levels, keys))
            packed = [perfect_hash.fingerprints(keys)[order].tobytes()]
            packed += [group.column(c).to_numpy()[order].astype(kind).tobytes()
                       for c, kind in (("shard", "<i4"), ("chunk", "<i4"), ("start", "<i8"), ("length", "<i8"))]
            yield pa.RecordBatch.from_arrays([group.column("bucket")[:1].combine_chunks(), pa.array([len(keys)], pa.int32()),
                                              *(pa.array([x], pa.binary()) for x in (levels, *packed))],
                                             ["bucket", "n", "levels", "marks", "shards", "chunks", "starts", "lengths"])

    known.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(index, INDEX).write.parquet(f"{path}/index")
    spark.createDataFrame([(buckets, dtype.itemsize, number)], "buckets long, id_bytes int, keys long").coalesce(1).write.parquet(f"{path}/meta")


def _bucket(buckets: int) -> F.Column:
    """The bucket of ``key``; null has one of its own, so that it can stand as key 0 there."""
    return F.when(F.col("key").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("long").alias("bucket")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """key, shard, chunk, start (within the shard), length of every stored document."""
    chunks = spark.read.parquet(f"{path}/payload").select("shard", "chunk", "n_ids", "keys", "counts")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    at = chunks.select("shard", "chunk", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("n_ids")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["keys"])
                starts = np.cumsum([row["base"], *row["counts"]])[:-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["keys"], pa.int64()), pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["chunk"], np.int32)),
                    pa.array(starts.astype(np.int64)), pa.array(row["counts"], pa.int64())], ["key", "shard", "chunk", "start", "length"])

    rows = chunks.drop("n_ids").join(at, ["shard", "chunk"]).select("shard", "chunk", "base", "keys", "counts")
    return rows.mapInArrow(explode, "key long, shard int, chunk int, start long, length long")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one bucket (first column), from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        for a, b in zip(c := [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist()], [*c[1:], len(bucket)], strict=True):
            if held and held[-1].column(0)[0].as_py() != bucket[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def lookup(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Where the ids of each distinct key are: key, shard, chunk, start (ids before it in the
    whole store), length. Keys that the store doesn't hold have no row."""
    spark = keys.sparkSession
    buckets = spark.read.parquet(f"{path}/meta").first()["buckets"]
    asked = keys.select(F.col(key).cast("long").alias("key")).distinct().select(_bucket(buckets), "key")
    index = spark.read.parquet(f"{path}/index")
    blobs = [c for c in index.columns if c != "bucket"]
    none = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in blobs]
    both = index.select("bucket", F.lit(0).alias("part"), F.lit(None).cast("long").alias("key"), *blobs).unionByName(
        asked.select("bucket", F.lit(1).alias("part"), "key", *none))
    both = both.repartition("bucket").sortWithinPartitions("bucket", "part")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_bucket(batches):
            part = group.column("part").to_numpy()
            if part[0] != 0 or len(part) == 1:
                continue
            held = {c: group.column(c)[0].as_py() for c in blobs}
            asked = group.column("key").slice(1).combine_chunks()
            raw = asked.fill_null(0).to_numpy().view(np.uint64)
            place = perfect_hash.places(held["levels"], raw)
            marks = np.frombuffer(held["marks"], "<u4")
            ok = (place >= 0) & (marks[np.maximum(place, 0)] == perfect_hash.fingerprints(raw))
            take = place[ok]
            columns = [np.frombuffer(held[c], kind)[take] for c, kind in (("shards", "<i4"), ("chunks", "<i4"), ("starts", "<i8"), ("lengths", "<i8"))]
            yield pa.RecordBatch.from_arrays([asked.filter(pa.array(ok)), *map(pa.array, columns)], ["key", "shard", "chunk", "start", "length"])

    found = both.mapInArrow(find, "key long, shard int, chunk int, start long, length long")
    firsts = spark.read.parquet(f"{path}/shards")
    if fits(firsts, 8 << 20):
        firsts = F.broadcast(firsts)
    return found.join(firsts, "shard").select(F.col("key").alias(key), "shard", "chunk", (F.col("first") + F.col("start")).alias("start"), "length")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Every stored document, from the payload: key, shard, chunk, nth (within the chunk), offset (ids
    before it in the chunk), n_tokens, ids (raw)."""
    width = spark.read.parquet(f"{path}/meta").first()["id_bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard", "chunk", "keys", "counts", "ids")}
                ends = np.cumsum([0, *row["counts"]])
                n = len(row["keys"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["keys"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()),
                    pa.array(ends[:-1]), pa.array(row["counts"], pa.int64()),
                    pa.array([row["ids"][a * width: b * width] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                    ["key", "shard", "chunk", "offset", "n_tokens", "ids"])

    rows = spark.read.parquet(f"{path}/payload").select("shard", "chunk", "keys", "counts", "ids")
    return rows.mapInArrow(cut, "key long, shard int, chunk int, offset long, n_tokens long, ids binary").withColumnRenamed("key", key)


def checksums(ids: F.Column, id_bytes: int) -> F.Column:
    """Unsigned crc32 of raw ids as little-endian unsigned 32-bit integers."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{id_bytes}").astype("<u4").tobytes()) for x in column], pa.int64())

    return F.arrow_udf(run, "long")(ids)


def digests(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` to a store and read it back: doc_id, start, n_tokens, ids_crc32 of every row, by the
    payload's chunks and by the index, which has to lead each key to its first ids."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-store")
    with open(tokenizer_path, encoding="utf-8") as f:
        write(docs, f.read(), path)
    id_bytes = spark.read.parquet(f"{path}/meta").first()["id_bytes"]
    rows = read(spark, path).withColumn("ids_crc32", checksums(F.col("ids"), id_bytes)).drop("ids")
    chunks = spark.read.parquet(f"{path}/payload").select("shard", "chunk", "n_ids")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(spark.read.parquet(f"{path}/shards"), "shard")
    bases = bases.select("shard", "chunk", (F.col("base") + F.col("first")).alias("base"))
    if fits(bases, 32 << 20):
        bases = F.broadcast(bases)
    rows = rows.join(bases, ["shard", "chunk"]).withColumn("start", F.col("base") + F.col("offset"))
    found = lookup(docs, path).select(F.col("doc_id").alias("_id"), F.col("start").alias("_start"), F.col("length").alias("_length"))
    inside = (F.col("start") >= F.col("_start")) & (F.col("start") < F.col("_start") + F.col("_length"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]), "left")
    lost = F.raise_error(F.concat(F.lit("the index does not lead to the ids of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    start = F.when(F.coalesce(inside, F.lit(False)), F.col("start")).otherwise(lost.cast("long"))
    return rows.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
