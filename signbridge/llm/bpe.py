"""Byte-level BPE encoding and decoding by a rank file.

Method: every match of the split pattern is encoded on its own. A match that is a token is
that token; the other distinct matches go, by length, into padded numpy matrices in which each
round merges every row's leftmost pair of minimum rank: pair ranks come from a hash table over
numpy arrays, and the rows are compacted after each merge. Matches of more than
``MATRIX_WIDTH`` bytes, for which rounds over padded rows cost the square of the length, take
the same merges from a heap.

Null and empty texts have no ids and decode to no bytes. Texts are taken whole, whatever
their length; repeated rows are encoded alike, and other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signbridge.llm.common import remember, text_arrays, text_slices

NO_RANK = np.int32(2**31 - 1)
MATRIX_WIDTH = 256
#: Text encoded at a time: enough distinct matches to fill matrices.
ENCODE_BYTES = 1 << 20
#: Cells of one matrix, and distinct matches a worker remembers: bounds of memory, not of results.
MATRIX_CELLS = 1 << 19
MEMO = 250_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


class PairRanks:
    """Hash table (open addressing, linear probing) from a pair of ids to the id it merges into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(len(merged) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY)
        self.ids = np.full(1 << bits, NO_RANK, np.int32)
        keys, merged = self._key(left, right), merged.astype(np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = keys[free]  # of several keys for one slot the last stays
            put = self.keys[at] == keys
            self.ids[at[put]] = merged[put]
            keys, merged, at = keys[~put], merged[~put], (at[~put] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        at = self._slot(keys)
        found = np.full(len(keys), NO_RANK, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys
            found[todo[hit]] = self.ids[at[hit]]
            on = ~hit & (held != _EMPTY)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & self.mask
        return found


class Codec:
    """Encoder and decoder of one rank file (lines of base64 token and rank) and split pattern."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(left, right, rank) for token, rank in ranks.items() for cut in range(1, len(token))
                 if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None]
        self.pairs = PairRanks(*np.array(pairs, np.int64).reshape(-1, 3).T)
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the n + 1 offsets of the texts."""
        matches = [self.pattern.findall(text) for text in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = [m for m in set().union(*matches) if m not in memo]
        memo.update(zip(new, self.encode_pieces([m.encode() for m in new]), strict=True))
        parts = [b"".join(map(memo.__getitem__, ms)) for ms in matches]
        ends = np.cumsum([0, *map(len, parts)]) // 4
        return np.frombuffer(b"".join(parts), np.int32), ends

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as raw 32-bit integers."""
        out = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, sys.byteorder)
            elif len(piece) > MATRIX_WIDTH:
                out[i] = np.array(self._by_heap(piece), np.int32).tobytes()
            elif piece:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(rows), step):
                self._by_matrix(pieces, rows[k: k + step], width, out)
        return out

    def _by_matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        length = np.array([len(pieces[i]) for i in rows])
        owner = np.array(rows)
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], np.int32(-1))
        rank = np.full((len(rows), width), NO_RANK, np.int32)  # of the pair that begins at the cell
        r, c = np.nonzero(np.arange(1, width + 1) < length[:, None])
        rank[r, c] = self.pairs.get(ids[r, c], ids[r, c + 1])
        while len(owner):
            at = rank.argmin(1)
            row = np.arange(len(owner))
            low = rank[row, at]
            done = low == NO_RANK
            if done.any():
                lines, size = ids[done].tobytes(), 4 * ids.shape[1]
                for k, (i, n) in enumerate(zip(owner[done].tolist(), length[done].tolist(), strict=True)):
                    out[i] = lines[k * size: k * size + 4 * n]
                go = ~done
                owner, ids, rank, length, at, low = owner[go], ids[go], rank[go], length[go], at[go], low[go]
                if not len(owner):
                    return
                row = np.arange(len(owner))
            ids[row, at] = low
            length -= 1
            top = int(length.max())  # every row lost a cell: the matrix narrows, too
            column = np.arange(top)
            source = np.minimum(column + (column > at[:, None]), ids.shape[1] - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            for shift in (-1, 0):
                left = at + shift
                real = (left >= 0) & (left + 1 < length)
                inside = (left >= 0) & (left < top)
                rank[row[inside], left[inside]] = NO_RANK
                rr, ll = row[real], left[real]
                rank[rr, ll] = self.pairs.get(ids[rr, ll], ids[rr, ll + 1])

    def _by_heap(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a byte
        live = [True] * n
        get = self.ranks.get
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not live[i] or middle >= n or end[middle] != stop:
                continue  # one of its parts has been merged meanwhile
            end[i], live[middle] = stop, False
            if stop < n:
                before[stop] = i
                if (rank := get(piece[i: end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := get(piece[left: stop])) is not None:
                heapq.heappush(heap, (rank, left, stop))
        return tuple(self.ranks[piece[i: end[i]]] for i in range(n) if live[i])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows in one array, and the n + 1 offsets of the rows."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.bytes[at], ends[offsets]


@lru_cache(maxsize=1)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker, until it does other work."""
    remember("bpe", _codec.cache_clear)
    return _codec(rank_file, pattern)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers).cast(pa.binary())


def encode(docs: DataFrame, rank_file: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, token_ids ARRAY<INT>."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for batch in text_slices(batches, max_bytes=ENCODE_BYTES, keeps="bpe"):
            ids, offsets = coder.encode(batch.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids, offsets)], ["doc_id", "token_ids"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, token_ids array<int>").withColumnRenamed("doc_id", doc_id)


def decode(encoded: DataFrame, rank_file: bytes, pattern: str, doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``encoded``: doc_id, token_ids, decoded BINARY."""
    ranks = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                lists = batch.column("token_ids")
                offsets = lists.offsets.to_numpy()
                data, ends = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, _binaries(data, ends)], ["doc_id", "token_ids", "decoded"])

    rows = encoded.select(encoded[doc_id].alias("doc_id"), "token_ids")
    return rows.mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary").withColumnRenamed("doc_id", doc_id)


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``, encoded and decoded again: doc_id, n_tokens, ids_sha256 (of the decimal ids,
    joined by a space), decoded_sha256, token_ids. Both ways run in one worker, so that an
    executor holds the tables once for each core."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for batch in text_slices(batches, max_bytes=ENCODE_BYTES, keeps="bpe"):
            ids, offsets = coder.encode(batch.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids, offsets), _binaries(*coder.decode(ids, offsets))],
                                             ["doc_id", "token_ids", "decoded"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    both = rows.mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids")
