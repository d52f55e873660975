"""Text quality by ordinal cumulative-link regression on graded ratings.

Method: one set of weights over hashed byte n-grams, and over the share of words that repeat the
word before them, gives a text its place f on a line; ordered thresholds t1 < t2 < ... cut the line into grades: P(grade >= k) = logistic(f - tk). The weights
are shared by all grades. The result is the expected grade and the tail probability of a
grade, by which documents are selected.

The model is fitted on at most ``per_grade`` rated rows of each grade, those with the least hashes
of their ids, weighted back to the grades' true shares. Held-out rows and rows without rating
or id teach nothing; of several ratings of an id the least counts. Null and empty texts have no
n-grams and are rated like an empty page: grade 0 and tail probability 0. With fewer than two
grades among the ratings every text gets the one grade there is (0 without any). Texts are
rated whole; repeated rows alike; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signbridge.llm.common import array_slices, fits, held_out, least_hashed, stored, text_arrays, text_slices
from signbridge.llm.linear import gram_counts, gram_means
from signbridge.llm.near_duplicates import word_hashes

ORDERS = (1, 2, 3)
BITS = 12
PER_GRADE = 1200


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def repeats(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the share of words that equal the word before them."""
    words, at = word_hashes(raw, offsets)
    again = np.concatenate([[0], np.cumsum(words[1:] == words[:-1])]) if len(words) else np.zeros(1, np.int64)
    last = np.maximum(at[1:] - 1, 0)
    first = np.minimum(at[:-1], max(0, len(words) - 1))
    return np.where(at[1:] > at[:-1], again[last] - again[first], 0) / np.maximum(at[1:] - at[:-1] - 1, 1)


class Model:
    """weights (slots x 1), weight of repeats, and thresholds; P(grade >= k) falls with k."""

    def __init__(self, grades: np.ndarray, counts: np.ndarray, repeated: np.ndarray, share: dict[int, float], ridge: float = 1e-4) -> None:
        self.grades = sorted(share)
        level = np.searchsorted(self.grades, grades)
        x = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        x = np.concatenate([x, repeated[:, None]], 1)
        scale = 1 / np.sqrt(x.mean(0) + 1e-7)  # rare n-grams weigh as much as frequent ones
        x = (x * scale).astype(np.float32)
        weight = np.array([share[g] / (grades == g).sum() for g in grades])
        weight /= weight.sum()
        k = len(self.grades)
        below = np.cumsum([weight[level == i].sum() for i in range(k - 1)])
        t = np.log(below / (1 - below))
        w = np.zeros(x.shape[1])

        def loss(w: np.ndarray, t: np.ndarray) -> float:
            a, b = self._ends(x @ w.astype(np.float32), level, t)
            return ridge * float(w @ w) - float(weight @ np.log(np.maximum(a - b, 1e-12)))

        now = loss(w, t)
        for _ in range(25):
            a, b = self._ends(x @ w.astype(np.float32), level, t)
            slope, bend = weight * (1 - a - b), weight * (a * (1 - a) + b * (1 - b))
            step = self._solve(x, bend, -(2 * ridge * w - x.T @ (-slope).astype(np.float32)), 2 * ridge)
            p = np.maximum(a - b, 1e-12)
            turn = np.zeros(k - 1)
            for i in range(k - 1):  # threshold i ends level i and begins level i + 1
                up, down = level == i, level == i + 1
                turn[i] = (weight * a * (1 - a) / p)[up].sum() - (weight * b * (1 - b) / p)[down].sum()
            bends = np.array([bend[(level == i) | (level == i + 1)].sum() + 1e-9 for i in range(k - 1)])
            size = 1.0
            while size > 1e-3:
                new_w, new_t = w + size * step, np.sort(t + size * turn / bends)
                if (new := loss(new_w, new_t)) < now:
                    break
                size /= 2
            else:
                break
            w, t, gain, now = new_w, new_t, now - new, new
            if gain < 1e-5 * abs(now):
                break
        w = (w * scale).astype(np.float32)
        self.weights, self.repeat, self.thresholds = w[:-1, None], float(w[-1]), t

    @staticmethod
    def _ends(f: np.ndarray, level: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(grade <= own) and P(grade < own)."""
        ends = np.concatenate([[-np.inf], t, [np.inf]])
        with np.errstate(invalid="ignore"):
            return logistic(ends[level + 1] - f), logistic(ends[level] - f)

    @staticmethod
    def _solve(x: np.ndarray, bend: np.ndarray, r: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
        step, p, rr = np.zeros_like(r), r.copy(), float(r @ r)
        stop = 1e-3 * rr
        for _ in range(rounds):
            hp = ridge * p + x.T @ (bend * (x @ p.astype(np.float32))).astype(np.float32)
            a = rr / max(float(p @ hp), 1e-30)
            step, r = step + a * p, r - a * hp
            rr, old = float(r @ r), rr
            if rr <= stop:
                break
            p = r + rr / old * p
        return step

    def rate(self, column: pa.Array, grade: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of at least ``grade``."""
        raw, offsets = text_arrays(column)
        f = gram_means(raw, offsets, ORDERS, BITS, self.weights)[:, 0] + self.repeat * repeats(raw, offsets)
        tails = logistic(f[:, None] - self.thresholds)
        expected = self.grades[0] + tails @ np.diff(self.grades)
        above = [i for i, g in enumerate(self.grades) if g >= grade]
        tail = np.zeros(len(f)) if not above else np.ones(len(f)) if above[0] == 0 else tails[:, above[0] - 1]
        none = offsets[1:] == offsets[:-1]
        return np.where(none, 0.0, expected), np.where(none, 0.0, tail)


class Constant:
    """The one grade that the ratings have."""

    def __init__(self, grade: int) -> None:
        self.grade = grade

    def rate(self, column: pa.Array, grade: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(column), float(self.grade)), np.full(len(column), float(self.grade >= grade))


def fit(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE) -> bytes:
    """The pickled model of ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade), learned in one task."""
    rated = ratings.where(F.col("grade").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = stored(rated.join(docs.where(F.length("text") > 0).select("doc_id").distinct(), "doc_id", "left_semi"), "rated")
    share = {r["grade"]: float(r["count"]) for r in rated.groupBy("grade").count().collect()}  # a row for each grade
    if len(share) < 2:
        return pickle.dumps(Constant(next(iter(share), 0)))
    ids = least_hashed(rated, ["grade"], F.lit(per_grade))
    if fits(ids, 32 << 20):
        ids = F.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            raw, offsets = text_arrays(batch.column("text"))
            counts = [c.astype(np.int32).tobytes() for c in gram_counts(raw, offsets, ORDERS, BITS)]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(counts, pa.binary()), pa.array(repeats(raw, offsets))],
                                             ["grade", "counts", "repeated"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("grade", "counts", "repeated")), strict=True)]
        rows.sort()  # whatever way they came
        counts = np.frombuffer(b"".join(c for _, c, _ in rows), np.int32).reshape(len(rows), -1).astype(np.float32)
        model = Model(np.array([g for g, _, _ in rows]), counts, np.array([r for _, _, r in rows]), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = docs.select("doc_id", "text").where(F.length("text") > 0).join(ids, "doc_id").select("grade", "text")
    learned = rows.mapInArrow(count, "grade int, counts binary, repeated double").repartition(1).mapInArrow(learn, "model binary")
    return bytes(learned.first()["model"])


def rated(text: Column, model: bytes, grade: int = 1) -> Column:
    """Struct of expected_grade and p_grade, the probability of at least ``grade``."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = pickle.loads(shared.value)
        for column in columns:
            parts = [held.rate(part, grade) for part in array_slices(column)] or [(np.zeros(0), np.zeros(0))]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["expected_grade", "p_grade"])

    return F.arrow_udf(run, "expected_grade double, p_grade double")(text.cast("string"))


def rate(docs: DataFrame, model: bytes, grade: int = 1, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, expected_grade, p_grade, selected (p_grade >= least)."""
    out = docs.select("doc_id", rated(F.col("text"), model, grade).alias("_p")).select("doc_id", "_p.expected_grade", "_p.p_grade")
    return out.withColumn("selected", F.col("p_grade") >= least)
