"""Sub-word vocabularies (byte-pair merges) learned and applied as Spark jobs.

The rule is greedy and exact: the pair of highest count is merged next (ties: the smallest
(left, right)), in one pass from left to right over every word, until the vocabulary is full.

Learning works on the distinct-word table (word, frequency), never on rows of text. Counting words
is the part that grows with the corpus; a table of distinct words that is measured to be
small (``task_bytes``) is then learned from in one task, with an index of where each symbol stands:
a merge touches the places of its pair, and no others. A larger table stays distributed: a round
guesses the next merges from the most frequent words, makes them in all words, and sums up what
each changes in the pair counts; with these, the merges are accepted one by one as long as the
next is the best pair, so a wrong guess costs time only. Both ways, and every batch size, give the same merges.

It is not bit-equal to the SentencePiece library. Encoding applies the merges by rank (lowest
first) to each distinct word.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens
from ..session import checkpoint, default_parallelism

# Fixed values of the sub-word format.
WORD_BOUNDARY = "▁"          # marks the start of a word
SEP = "\u0001"                    # symbol separator inside the working strings
SPECIAL_PIECES = 3                # <unk>, <s>, </s> are part of the vocabulary size
DEFAULT_VOCAB_SIZE = 2000
# Bytes of distinct words that one task learns from.
TASK_BYTES = 32 * 1024 * 1024
# Words of a row of chains; most frequent words that the next merges are guessed from.
CHAIN_WORDS = 200_000
SAMPLE_WORDS = 50_000
# Words whose pieces a task keeps while it encodes.
MEMO_WORDS = 200_000


def word_frequencies(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Whitespace words of every line with their corpus frequency."""
    w = lines.select(F.explode(whitespace_tokens(text_col)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _symbols(word) -> F.Column:
    return F.split(F.concat(F.lit(WORD_BOUNDARY), word), "")


def initial_segments(freqs: DataFrame) -> DataFrame:
    """(word, freq, seg) with ``seg`` = SEP-delimited characters of ``▁word``."""
    syms = _symbols(F.col("word"))
    seg = F.concat(F.lit(SEP), F.array_join(syms, SEP), F.lit(SEP))
    return freqs.select("word", "freq", seg.alias("seg"))


def pair_counts(segs: DataFrame) -> DataFrame:
    """Weighted counts of adjacent symbol pairs: (left, right, cnt)."""
    arr = F.filter(F.split(F.col("seg"), SEP), lambda s: s != "")
    pairs = F.arrays_zip(F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0))),
                         F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0))))
    ex = segs.select("freq", F.explode(pairs).alias("p"))
    return ex.groupBy(F.col("p").getField("0").alias("left"), F.col("p").getField("1").alias("right")) \
             .agg(F.sum("freq").alias("cnt"))


def _pick(candidates: list, k: int) -> list:
    """The best pairs up to the first that interacts with a better one.

    (a, b) and (c, d) interact only through a shared middle symbol (b == c or d == a), or where
    one's merged symbol is a symbol of the other. Up to there the counts of the chosen pairs don't
    change while the better ones are merged."""
    chosen: list = []
    lefts, rights, syms, merged = set(), set(), set(), set()
    for row in candidates[:k]:
        a, b = row["left"], row["right"]
        if a in rights or b in lefts or a in merged or b in merged or (a + b) in syms or (a + b) in merged:
            break
        chosen.append((a, b, int(row["cnt"])))
        lefts.add(a)
        rights.add(b)
        syms.update((a, b))
        merged.add(a + b)
    return chosen


def _merge_expr(seg, pairs: list[tuple[str, str]]):
    """Apply one round of merges (pairs share no symbol) in a single left-to-right pass.

    Each alternative consumes its leading separator and only looks ahead at the trailing
    one, so runs like ``a a a a`` merge as ``aa aa``. Groups of alternatives that did not
    match add nothing to the replacement."""
    alts, repl = [], [SEP.replace("$", "\\$")]
    for i, (a, b) in enumerate(pairs):
        alts.append(f"({re.escape(a)}){re.escape(SEP)}({re.escape(b)})")
        repl.append(f"${2 * i + 1}${2 * i + 2}")
    pattern = re.escape(SEP) + "(?:" + "|".join(alts) + ")(?=" + re.escape(SEP) + ")"
    return F.regexp_replace(seg, pattern, "".join(repl))


class _Chain:
    """Words as one chain of symbol numbers, and for the symbols in ``wanted`` (all, if none is given) where they stand:
    a merge looks at the places of one symbol and tells how the counts of the neighbours change."""

    def __init__(self, symbol: np.ndarray, lengths: np.ndarray, freqs: np.ndarray, wanted: list[int] | None = None) -> None:
        self.symbol = symbol.astype(np.int64)
        size, ends = len(symbol), np.cumsum(lengths)
        self.weight = np.repeat(freqs.astype(np.int64), lengths)
        self.after, self.before = np.arange(1, size + 1), np.arange(-1, size - 1)
        self.after[ends - 1] = -1
        self.before[ends - lengths] = -1
        last = max([int(self.symbol.max(initial=0)), *(wanted or [])])
        known = np.full(last + 1, wanted is None)
        known[wanted or []] = True
        at = np.flatnonzero(known[self.symbol])
        at = at[np.argsort(self.symbol[at], kind="stable")]
        cuts = np.searchsorted(self.symbol[at], np.arange(last + 2))
        self.places = {n: at[cuts[n]: cuts[n + 1]] for n in np.flatnonzero(known).tolist()}

    def copy(self) -> _Chain:
        out = object.__new__(_Chain)
        out.symbol, out.weight, out.after, out.before = self.symbol.copy(), self.weight, self.after.copy(), self.before.copy()
        out.places = dict(self.places)
        return out

    def _pairs(self, at: np.ndarray) -> np.ndarray:
        return self.symbol[at] << 32 | self.symbol[self.after[at]]

    def _changes(self, parts: list[tuple[np.ndarray, int]], keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, and the sums of the weights of the given places, with their signs."""
        pairs, which = np.unique(np.concatenate(keys), return_inverse=True)
        change = np.bincount(which, np.concatenate([sign * self.weight[at] for at, sign in parts]), len(pairs)).astype(np.int64)
        return pairs[change != 0], change[change != 0]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.after >= 0)
        return self._changes([(at, 1)], [self._pairs(at)])

    def merge(self, a: int, b: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pair (a, b) into the symbol ``number``; the pairs whose counts change, and by how much."""
        none = np.zeros(0, np.int64)
        at = self.places.get(a, none)
        at = self.places[a] = at[self.symbol[at] == a]
        second = self.after[at]
        at = at[(second >= 0) & (self.symbol[second] == b)]
        if a == b:  # in a row of equal symbols every other place, from the left
            head = np.concatenate([[True], self.after[at[:-1]] != at[1:]])[: len(at)]
            run = np.flatnonzero(head)[np.cumsum(head) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            return none, none
        second = self.after[at]
        back = self.before[at]
        gone = np.unique(np.concatenate([back[back >= 0], at, second[self.after[second] >= 0]]))
        keys = [self._pairs(gone)]
        on = self.after[second]
        self.symbol[at], self.symbol[second], self.after[at] = number, -1, on
        self.before[on[on >= 0]] = at[on >= 0]
        self.places[number] = np.sort(np.concatenate([self.places.get(number, none), at]))
        back = self.before[at]
        made = np.unique(np.concatenate([back[back >= 0], at[on >= 0]]))
        return self._changes([(gone, -1), (made, 1)], [*keys, self._pairs(made)])


class _Counts:
    """Names of symbols, counts of pairs, and the best pair."""

    def __init__(self, names: list[str]) -> None:
        self.names = list(names)
        self.numbers = {c: i for i, c in enumerate(names)}
        self.of: dict[int, int] = {}
        self.heap: list[tuple] = []

    def copy(self) -> _Counts:
        out = object.__new__(_Counts)
        out.names, out.numbers, out.of, out.heap = self.names.copy(), self.numbers.copy(), self.of.copy(), self.heap.copy()
        return out

    def add(self, pairs: np.ndarray, change: np.ndarray) -> None:
        for pair, n in zip(pairs.tolist(), change.tolist()):
            now = self.of[pair] = self.of.get(pair, 0) + n
            if now > 0:
                heapq.heappush(self.heap, (-now, self.names[pair >> 32], self.names[pair & 0xFFFFFFFF], pair))
            else:
                del self.of[pair]

    def best(self) -> tuple[str, str, int] | None:
        while self.heap:
            n, left, right, pair = self.heap[0]
            if self.of.get(pair) == -n:
                return left, right, -n
            heapq.heappop(self.heap)  # its count has changed meanwhile
        return None

    def merge(self, left: str, right: str) -> tuple[int, int, int]:
        """The numbers of the two symbols and of what they become."""
        name = left + right
        if name not in self.numbers:
            self.numbers[name] = len(self.names)
            self.names.append(name)
        return self.numbers[left], self.numbers[right], self.numbers[name]


def _numbered(words: list[str], alphabet: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the words, as places in the sorted ``alphabet``, and each word's number of them."""
    text = "".join(WORD_BOUNDARY + w for w in words)
    signs = np.array([ord(c) for c in alphabet], np.uint32)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return np.searchsorted(signs, np.frombuffer(text.encode("utf-32-le"), np.uint32)), lengths


def _merged(symbols: list[str], pair: tuple) -> list[str]:
    """``symbols`` with every occurrence of the pair merged, left to right."""
    out, i, last = [], 0, len(symbols) - 1
    while i <= last:
        if i < last and symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


MERGES = "rank long, left string, right string, piece string, cnt long"


def _learn_in_one_task(freqs: DataFrame, budget: int) -> DataFrame:
    """All merges of a word table of bounded size."""

    def run(batches):
        words, freqs_ = [], []
        for batch in batches:
            words += batch.column("word").to_pylist()
            freqs_ += batch.column("freq").to_pylist()
        names = sorted({WORD_BOUNDARY, *"".join(words)})
        counts, rows = _Counts(names), []
        if words:
            chain = _Chain(*_numbered(words, names), np.array(freqs_, np.int64))
            counts.add(*chain.counts())
        while len(rows) < budget and (best := counts.best()) is not None:
            left, right, n = best
            rows.append((len(rows), left, right, left + right, n))
            counts.add(*chain.merge(*counts.merge(left, right)))
        fields = [("rank", pa.int64()), ("left", pa.string()), ("right", pa.string()), ("piece", pa.string()), ("cnt", pa.int64())]
        columns = zip(*rows) if rows else [[]] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    return freqs.select("word", "freq").coalesce(1).mapInArrow(run, MERGES)


CHAINS = "symbols binary, lengths binary, freqs binary"


def _packed(symbols, lengths, freqs) -> pa.RecordBatch:
    row = [np.ascontiguousarray(x, t).tobytes() for x, t in ((symbols, np.int32), (lengths, np.int32), (freqs, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["symbols", "lengths", "freqs"])


def _chains(freqs: DataFrame, alphabet: list[str]) -> DataFrame:
    """The word table as rows of at most ``CHAIN_WORDS`` words, in numbers."""

    def run(batches):
        words, counts = [], []
        for batch in batches:
            words += batch.column("word").to_pylist()
            counts += batch.column("freq").to_pylist()
            if len(words) >= CHAIN_WORDS:
                yield _packed(*_numbered(words, alphabet), counts)
                words, counts = [], []
        if words:
            yield _packed(*_numbered(words, alphabet), counts)

    return freqs.select("word", "freq").mapInArrow(run, CHAINS)


def _unpacked(batches, merges: list[tuple[int, int, int]]):
    for batch in batches:
        for i in range(batch.num_rows):
            symbols, lengths, freqs = (np.frombuffer(batch.column(n)[i].as_py(), t)
                                       for n, t in (("symbols", np.int32), ("lengths", np.int32), ("freqs", np.int64)))
            yield _Chain(symbols, lengths.astype(np.int64), freqs, sorted({a for a, _, _ in merges})), lengths, freqs


def _changes(chains: DataFrame, done: list, batch: list) -> pa.Table:
    """(step, pair, change): what each merge of the batch, after those done, changes in the counts of all words; without a
    batch, the counts themselves. The sums are as many as the pairs of a vocabulary."""

    def run(batches):
        for chain, _, _ in _unpacked(batches, done + batch):
            for merge in done:
                chain.merge(*merge)
            for step, (pairs, change) in enumerate([chain.merge(*m) for m in batch] if batch else [chain.counts()]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), step, np.int32)), pa.array(pairs), pa.array(change)],
                                                 names=["step", "pair", "change"])

    found = chains.mapInArrow(run, "step int, pair long, change long")
    return found.groupBy("step", "pair").agg(F.sum("change").alias("change")).where("change <> 0").toArrow()


def _applied(chains: DataFrame, done: list) -> DataFrame:
    """The chains after merges."""

    def run(batches):
        for chain, lengths, freqs in _unpacked(batches, done):
            for merge in done:
                chain.merge(*merge)
            live = chain.symbol >= 0
            word = np.repeat(np.arange(len(lengths)), lengths)[live]
            yield _packed(chain.symbol[live], np.bincount(word, minlength=len(lengths)), freqs)

    return chains.mapInArrow(run, CHAINS)


def _expected(counts: _Counts, sample: _Chain, size: int) -> list[tuple[str, str, int, int, int]]:
    """The merges that are likely to come next: the counts are right now, and change as in a sample of words."""
    counts, sample, out = counts.copy(), sample.copy(), []
    while len(out) < size and (best := counts.best()) is not None:
        left, right, n = best
        merge = counts.merge(left, right)
        pair = merge[0] << 32 | merge[1]
        pairs, change = sample.merge(*merge)
        own = -int(change[pairs == pair].sum())
        other = pairs != pair
        counts.add(np.array([pair]), np.array([-n]))
        if own > 0:
            counts.add(pairs[other], np.rint(change[other] * (n / own)).astype(np.int64))
        out.append((left, right, *merge))
    return out


def learn_merges(lines: DataFrame, vocab_size: int = DEFAULT_VOCAB_SIZE, text_col: str = "text",
                 merges_per_round: int = 64, task_bytes: int = TASK_BYTES, checkpoint_every: int = 8) -> DataFrame:
    """Learn merges until the vocabulary (specials + characters + merges) reaches
    ``vocab_size``. Returns (rank, left, right, piece, cnt).

    ``task_bytes`` bounds the words that one task learns from (their UTF-8 bytes, and 64 for each); of
    more, at most ``merges_per_round`` are merged in a round, and words are written anew after
    ``checkpoint_every`` times as many."""
    spark = lines.sparkSession
    freqs = checkpoint(word_frequencies(lines, text_col))
    alphabet = freqs.select(F.explode(_symbols(F.col("word"))).alias("c")).distinct().count()
    budget = vocab_size - SPECIAL_PIECES - alphabet
    if budget < 0:
        raise ValueError(f"a vocabulary of {vocab_size} doesn't hold the {alphabet} characters of the text and {SPECIAL_PIECES} special pieces")
    size = freqs.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()[0]
    if size <= task_bytes:
        return _learn_in_one_task(freqs, budget)
    letters = sorted(r[0] for r in freqs.select(F.explode(_symbols(F.col("word"))).alias("c")).distinct().collect())  # fit the vocabulary
    chains = checkpoint(_chains(freqs.repartition(default_parallelism(spark), "word"), letters))
    top = freqs.orderBy(F.desc("freq"), "word").limit(SAMPLE_WORDS).toArrow()
    sample = _Chain(*_numbered(top.column("word").to_pylist(), letters), top.column("freq").to_numpy())
    counts, done, merges = _Counts(letters), [], []
    start = _changes(chains, [], [])
    counts.add(start.column("pair").to_numpy(), start.column("change").to_numpy())
    while len(merges) < budget:
        batch = _expected(counts, sample, min(merges_per_round, budget - len(merges)))
        if not batch:
            break
        found = _changes(chains, done, [m[2:] for m in batch])
        step, pairs, change = (found.column(c).to_numpy() for c in ("step", "pair", "change"))
        for i, (left, right, *merge) in enumerate(batch):
            best = counts.best()
            if best is None or best[:2] != (left, right):
                break  # after the merges so far, another pair is the best
            merges.append(best)
            counts.merge(left, right)
            counts.add(pairs[step == i], change[step == i])
            done.append(tuple(merge))
            sample.merge(*merge)
        if len(done) >= checkpoint_every * merges_per_round:
            chains, done = checkpoint(_applied(chains, done)), []
    rows = [(i, a, b, a + b, c) for i, (a, b, c) in enumerate(merges)]
    return spark.createDataFrame(rows, MERGES)


def _encode_word(word: str, ranks: dict) -> list[str]:
    syms = list(WORD_BOUNDARY + word)
    while len(syms) > 1:
        best, at = None, -1
        for i in range(len(syms) - 1):
            r = ranks.get((syms[i], syms[i + 1]))
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        syms = _merged(syms, (syms[at], syms[at + 1]))
    return syms


def encode_lines(lines: DataFrame, merges: DataFrame, text_col: str = "text",
                 out_col: str = "pieces") -> DataFrame:
    """Encode each line into space-joined pieces with the learned merges; a null line stays null.

    Each task encodes a word once, as far as its memo reaches; nothing is shuffled. The merge table
    is as large as the vocabulary that was asked for."""
    table = {(r["left"], r["right"]): int(r["rank"]) for r in merges.collect()}
    bc = lines.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        word = functools.lru_cache(MEMO_WORDS)(lambda w: " ".join(_encode_word(w, bc.value)))
        for part in parts:
            yield part.map(lambda words: None if words is None else " ".join(map(word, words)))

    return lines.withColumn(out_col, encode(whitespace_tokens(text_col)))


def decode_pieces(pieces) -> F.Column:
    """Pieces -> text: drop the piece separators, word boundaries become spaces."""
    c = F.col(pieces) if isinstance(pieces, str) else pieces
    return F.trim(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit(WORD_BOUNDARY), F.lit(" ")))


def char_pieces(text) -> F.Column:
    """The trivial encoding (every character its own piece) of whitespace words."""
    c = F.col(text) if isinstance(text, str) else text
    words = whitespace_tokens(c)
    return F.array_join(F.transform(words, lambda w: F.array_join(_symbols(w), " ")), " ")
