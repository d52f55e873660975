"""Toxicity by class-conditional Kneser-Ney models.

Method: the words of toxic and of ordinary labelled texts each give a model. A word counts by
the number of distinct words that it follows (its continuations), so that copies and repeated
lines add nothing. Each count is discounted by ``DISCOUNT``, and the mass that this frees goes
to shared backoff counts, the continuations of the word over all documents:

    p(w | class) = (max(c(w) - d, 0) + M * shared(w)) / C,   M = sum of min(c, d), C = sum of c

A word that a class has hardly seen thus gets what all documents together say of it, and
tells the classes apart by nothing. A text is scored by the logarithms of toxic against
ordinary likelihood, normalised by length: over the whole text, and over its most telling
words (a few insults in a long text vanish in its mean). A logistic regression on labelled
texts that the models have not seen turns these into a score from 0 to 1.

Words are runs of letters (ASCII letters in lower case, and anything beyond ASCII). Labels of
held-out rows, null labels and rows without id teach nothing; of several labels of an id the
larger counts. The models are fitted on at most ``MODEL_ROWS`` texts of each class, and
calibrated on at most ``CALIBRATION_ROWS`` more of each, those with the least hashes of their ids;
the shared counts are taken over all documents. Null and empty texts have no words and get
the score of a text without evidence. If either class has no labels, every score is 0. Texts
are scored whole; repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signbridge.llm.common import array_slices, distinct, fits, fresh, held_out, least_hashed, stored, text_slices
from signbridge.llm.linear import letters
from signbridge.llm.near_duplicates import mix, word_hashes

DISCOUNT = 2
#: Bounds of the labelled samples, rows of class 0 and 1.
MODEL_ROWS = (6000, 3000)
CALIBRATION_ROWS = (4000, 2000)
#: Buckets in which the corpus's continuations are made distinct, by hash of the word before.
BUCKETS_PER_PARTITION = 1
_BEFORE_FIRST = np.uint64(0x5DEECE66D)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, hash of the word before it, and the n + 1 word offsets of the texts."""
    words, at = word_hashes(*letters(column))
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[at[:-1][at[:-1] < at[1:]]] = _BEFORE_FIRST
    return words, before, at


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled texts that teach: toxic, role (0 models, 1 calibration), text."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    hashed = F.xxhash64("doc_id")
    known = stored(known.withColumn("role", (F.pmod(F.shiftright(hashed, 20), F.lit(10)) >= 7).cast("int")), "toxicity-known")
    most = F.element_at(F.array(*map(F.lit, MODEL_ROWS + CALIBRATION_ROWS)), F.col("role") * 2 + F.col("toxic").cast("int") + 1)
    ids = stored(least_hashed(known, ["toxic", "role"], most).select("doc_id", "toxic", "role"), "toxicity-ids")
    if fits(ids, 32 << 20):
        ids = F.broadcast(ids)
    return stored(docs.select("doc_id", "text").join(ids, "doc_id").select("toxic", "role", "text"), "toxicity-sample")


def class_counts(rows: DataFrame) -> DataFrame:
    """word (hash), ordinary and toxic: continuations of the word in the texts of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, before, at = tokens(batch.column("text"))
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(before.view(np.int64)),
                                              pa.array(toxic.astype(np.int32))], ["word", "before", "toxic"])

    pairs = rows.select("toxic", "text").mapInArrow(run, "word long, before long, toxic int").distinct()
    return pairs.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("ordinary"), F.sum("toxic").alias("toxic"))


def shared_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Over all documents: continuations of each word of ``vocabulary`` (sorted hashes), and of all words.

    A task makes its pairs distinct and sends them as sorted 64-bit keys (place of the word, 40
    bits of the word before), dealt by the word before; a frequent word's pairs are so spread
    over all buckets, in each of which they are made distinct and counted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    buckets = max(8, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = np.uint64((1 << 40) - 1)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = distinct(np.concatenate(held))
            bucket = (keys & low) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            keys, cuts = keys[order], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            held.clear()
            planes = [keys[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(planes, pa.binary())], ["bucket", "keys"])

        for batch in text_slices(batches):
            words, before, _ = tokens(batch.column("text"))
            place = np.minimum(np.searchsorted(known, words), len(known) - 1) if len(known) else np.zeros(len(words), np.int64)
            inside = known[place] == words if len(known) else np.zeros(len(words), bool)
            # words outside the vocabulary share the last place, told apart by the hash of the pair
            place = np.where(inside, place, len(known)).astype(np.uint64)
            context = np.where(inside, mix(before), mix(words ^ mix(before)))
            held.append(distinct(place << np.uint64(40) | context & low))
            size += len(held[-1])
            if size > 2_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0

        def counted() -> pa.RecordBatch:
            place = distinct(np.concatenate(held)) >> np.uint64(40)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            n = np.diff(np.append(first, len(place)))
            return pa.RecordBatch.from_arrays([pa.array(place[first].astype(np.int64)), pa.array(n)], ["place", "n"])

        for batch in batches:
            for b, planes in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if b != bucket and held:
                    yield counted()
                    held, size = [], 0
                bucket = b
                held.append(np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel())
                size += len(held[-1])
                if size > 8_000_000:  # a bucket's keys so far, made distinct
                    held = [distinct(np.concatenate(held))]
                    size = len(held[0])
        if held:
            yield counted()

    keys = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(collect, "bucket int, keys binary")
    keys = keys.where(F.length("keys") > 0).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counts = keys.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    return out[:-1], int(out.sum())


@dataclass
class Model:
    """Log-likelihood ratios by word hash, that of any other word, and the calibration."""

    words: np.ndarray
    ratios: np.ndarray
    rest: float
    coefficients: np.ndarray | None = None

    def features(self, column: pa.Array) -> np.ndarray:
        words, _, at = tokens(column)
        ratios = np.full(len(words), self.rest)
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[place] == words
            ratios[hit] = self.ratios[place[hit]]
        sums = np.concatenate([[0.0], np.cumsum(ratios)])
        out = np.zeros((len(at) - 1, 3))
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if a < b:
                top = np.sort(ratios[a:b])[-2:] if b - a < 3 else -np.partition(-ratios[a:b], 1)[:2]
                out[i] = (sums[b] - sums[a]) / (b - a), top.max(), top.sum() / 2
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        x = self.features(column)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[:-1] + self.coefficients[-1], -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients and intercept by Newton's method, on standardised columns with a small ridge."""
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - middle) / spread, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    pull = np.array([ridge] * x.shape[1] + [0.0]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        hessian = z.T * (p * (1 - p)) @ z + np.diag(pull + 1e-9)
        step = np.linalg.solve(hessian, z.T @ (y - p) - pull * w)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())


def fit(docs: DataFrame, labels: DataFrame, discount: float = DISCOUNT) -> Model | None:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); None if a class has no texts."""
    rows = sample(docs, labels)
    parts = {(r["toxic"], r["role"]) for r in rows.select("toxic", "role").distinct().collect()}
    if not {t for t, _ in parts} >= {0, 1}:
        return None
    # with so few labels that one part lacks a class, one set of rows serves for both
    models = rows.where("role = 0") if {(0, 0), (1, 0)} <= parts else rows
    calibration = rows.where("role = 1") if {(0, 1), (1, 1)} <= parts else rows
    counts = stored(class_counts(models), "toxicity-counts")
    freed = [F.sum(F.least(F.col(c), F.lit(discount))) for c in ("ordinary", "toxic")]
    total = [F.sum(c) for c in ("ordinary", "toxic")]
    mass_o, mass_t, all_o, all_t = (float(v or 0) for v in counts.agg(*freed, *total).first())
    if not all_o or not all_t:
        return None
    # at most a word for every few words of the bounded sample
    seen = counts.where((F.col("ordinary") > discount) | (F.col("toxic") > discount)).toArrow()
    words = seen.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, c_o, c_t = words[order], seen.column("ordinary").to_numpy()[order], seen.column("toxic").to_numpy()[order]
    shared, everything = shared_counts(docs, words)
    share = (shared + 0.5) / (everything + 0.5 * len(words))
    p_t = (np.maximum(c_t - discount, 0) + mass_t * share) / all_t
    p_o = (np.maximum(c_o - discount, 0) + mass_o * share) / all_o
    model = Model(words, np.log(p_t / p_o), float(np.log(mass_t / all_t) - np.log(mass_o / all_o)))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = held.value.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    known = calibration.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, x array<double>").toPandas()
    x = np.stack(known["x"].to_numpy())
    y = known["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums in one order, whatever way the rows came
    model.coefficients = logistic(x[order], y[order])
    return model


def scored(text: Column, model: Model | None) -> Column:
    """Score from 0 to 1 of each text."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if shared.value is None:
                yield pa.array(np.zeros(len(column)))
            else:
                parts = [shared.value.scores(part) for part in array_slices(column)]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(run, "double")(text.cast("string"))


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted."""
    return docs.select(doc_id, scored(F.col(text), model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_ordinary(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all others stay as they are."""
    name = fresh(docs, "_score")
    return docs.withColumn(name, scored(F.col(text), model)).where(F.col(name) < 0.5).drop(name)
