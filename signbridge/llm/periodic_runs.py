"""Periodic runs of words within a document, and texts with the repetitions collapsed.

A run is a stretch of words with smallest period q (words q apart are identical), at least
``max(least, 2 * q)`` words long, that no neighbouring word extends.

Method: seed and extend along diagonals. A run of period q is a stretch of matches between the
document and itself shifted by the lag q, at least ``max(least - q, q)`` matches long: the
overlap that is guaranteed. Lags are taken in classes, q in 1..7 and then from one power of two to the
next; with the least overlap m of a class, every stretch contains a whole block of about m / 2
words that begins at a multiple of the block size. So the index of k-grams is probed at these
positions only, for later occurrences in the same document at a lag of the class. That bounds the
pairs of a class by twice the number of words however often a k-gram repeats, and no pair
that could matter is left out. Pairs are taken by lag and position: a pair that the
furthest-covered word of its lag already reaches is not extended again. What is left is extended
to both sides by less than a block, doubling steps over the names of shorter grams. Of stretches that
cover the same words the one with the least lag has the smallest period.

The k-grams have exact names (a gram of 2k words is named by the names of its halves), so no
hash can collide; a gram that does not repeat within its document is dropped at once, so that
few positions are left after the first classes.

Cases: null and empty texts, and those without words, have no runs. Texts are taken whole;
very long ones are a slice of their own, and a class with very many pairs is worked off in
ranges of lags. Repeated rows are treated alike, a null id is kept, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signbridge.llm.common import SLICE_BYTES, text_slices

LEAST_WORDS = 12
#: Pairs held at a time; a class of lags with more is split into ranges of lags.
MAX_PAIRS = 1 << 20
WORD_SPLIT = r"[\x20\x09-\x0D]+"
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _renamed(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of the positions ``at`` by their keys; a position whose key no other shares has one of its own below 0."""
    names = -1 - np.arange(size)
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    again = np.bincount(group, minlength=1)[group] > 1 if len(keys) else new
    names[at[again]] = group[again]
    return names


class _Names:
    """Names of the grams of 1, 2, 4, ... words at every position, made when first asked for."""

    def __init__(self, words: np.ndarray, owner: np.ndarray) -> None:
        size = len(words)
        self.levels = [_renamed(owner * (int(words.max(initial=0)) + 1) + words, np.arange(size), size)]

    def __getitem__(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            left, right = last[: max(0, len(last) - half)], last[half:]
            at = np.flatnonzero((left >= 0) & (right >= 0))
            self.levels.append(_renamed(left[at] * (len(last) + 1) + right[at], at, len(last)))
        return self.levels[level]


def _lag_classes(least: int, longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(least lag, greatest lag, level of the gram, step of the probed positions) for lags up to ``longest``."""
    low = 1
    while low <= longest:
        # the greatest class that begins at ``low`` and whose overlap still holds a block of two words
        high = low
        overlap = max(least - low, low)
        while high < longest and high + 1 < 2 * max(low, 4):
            high += 1
            overlap = min(overlap, max(least - high, high))
        level = 0
        while (2 << level) * 2 - 1 <= overlap:
            level += 1
        step = 1 << level
        if (2 << level) + step - 1 <= overlap:  # room for a gram twice as long
            level += 1
        yield low, min(high, longest), level, step
        low = high + 1


def find(words: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """Runs in the documents whose words (numbers) stand one after another in ``words``: document i ends
    before ``ends[i]``. Arrays of document, start in it, length and period, by document, start and period."""
    size = len(words)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    names = _Names(words.astype(np.int64), owner)
    found = [np.zeros((3, 0), np.int64)]
    longest = int((ends - starts).max(initial=0)) // 2
    for low, high, level, step in _lag_classes(least, longest):
        name = names[level]
        at = np.flatnonzero(name >= 0)
        if not len(at):
            break  # nothing that repeats is as long
        at = at[np.argsort(name[at], kind="stable")]
        index = name[at] * size + at
        probes = np.flatnonzero(name[::step] >= 0) * step
        base = name[probes] * size + probes
        many = int((np.searchsorted(index, base + high, side="right") - np.searchsorted(index, base + low)).sum())
        width = max(1, (high - low + 1) * MAX_PAIRS // max(many, MAX_PAIRS))
        for first in range(low, high + 1, width):
            last = min(first + width - 1, high)
            begin = np.searchsorted(index, base + first)
            stop = np.searchsorted(index, np.minimum(base + last, name[probes] * size + size - 1), side="right")
            count = np.maximum(stop - begin, 0)
            left = np.repeat(probes, count)
            where = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
            found.append(_extended(names, size, left, at[where] - left, level, step, least))
    start, length, period = np.concatenate(found, 1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    if len(start):
        primitive = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
        start, length, period = start[primitive], length[primitive], period[primitive]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return owner[start], start - starts[owner[start]], length, period


def _extended(names: _Names, size: int, left: np.ndarray, lag: np.ndarray, level: int, step: int, least: int) -> np.ndarray:
    """(start, length, lag) of the stretches that the pairs belong to, those that are long enough."""
    order = np.argsort(lag * size + left)
    left, lag = left[order], lag[order]
    # the furthest-covered word of the lag reaches a pair that follows one step behind the last
    head = np.concatenate([[True], (lag[1:] != lag[:-1]) | (left[1:] != left[:-1] + step)]) if len(left) else np.zeros(0, bool)
    tail = np.concatenate([head[1:], [True]]) if len(left) else head
    start, stop, lag = left[head], left[tail] + (1 << level), lag[head]
    for k in range(step.bit_length() - 2, -1, -1):
        grams, jump = names[k], 1 << k
        back = np.maximum(start - jump, 0)
        start = np.where((start >= jump) & (grams[back] == grams[back + lag]), back, start)
        on = np.minimum(stop + lag, size - 1)
        inside = stop + lag + jump <= size
        stop = np.where(inside & (grams[np.minimum(stop, size - 1)] == grams[on]), stop + jump, stop)
    length = stop - start + lag
    keep = length >= np.maximum(least, 2 * lag)
    return np.stack([start[keep], length[keep], lag[keep]])


def runs(docs: DataFrame, least: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed,
    the words joined by one space without those that a run contains after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, max_bytes=SLICE_BYTES):
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split()
                     for t in batch.column("text").cast(pa.large_binary())]
            numbers = {w: i for i, w in enumerate(set().union(*texts))}
            ends = np.cumsum([len(t) for t in texts])
            words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(ends[-1]))
            owner, start, length, period = find(words, ends, least)
            held = np.searchsorted(owner, np.arange(len(texts) + 1))
            collapsed = []
            for i, own in enumerate(texts):
                if held[i] == held[i + 1]:
                    collapsed.append(b" ".join(own))
                    continue
                part = slice(held[i], held[i + 1])
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, start[part] + period[part], 1)
                np.add.at(change, start[part] + length[part], -1)
                keep = np.cumsum(change[:-1]) == 0
                collapsed.append(b" ".join([w for w, k in zip(own, keep.tolist(), strict=True) if k]))
            fields = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(held, pa.int32()), fields), pa.array([c.decode() for c in collapsed], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")
    return out.withColumnRenamed("doc_id", doc_id)


def longest(found: str = "runs") -> F.Column:
    """The run of greatest length (ties: least start, then period) of a column of runs, as a struct of
    start, length, period and exponent_milli; null fields without a run."""
    ranked = F.array_sort(F.transform(found, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    best = F.get(ranked, F.lit(0))
    milli = (-1000 * best["l"] - F.pmod(-1000 * best["l"], best["p"])) / best["p"]  # exact: the quotient has no rest
    return F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"), milli.cast("long").alias("exponent_milli"))


def run_lines(found: str = "runs") -> F.Column:
    """All runs as lines of ``start,length,period``."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(found, line), "")


def with_planted_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, with a periodic tail planted in every document whose h = crc32(id as text) is divisible by
    10: with g = h div 10 and n words, each word i >= a becomes the word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8). The words of such a text are joined by one space; others stay as they are."""
    h = F.crc32(docs[doc_id].cast("string").cast("binary"))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), h.alias("h"))
    words = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", WORD_SPLIT), lambda x: x != "")))
    words = words.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    words = words.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 as int)))), ' ')")
    out = words.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
    return out.withColumnsRenamed({"doc_id": doc_id, "text": text})
