"""Language identification in two steps: the family first, then the language within the family.

Method: linear support vector machines over hashed byte n-grams. One machine for each family
against all others decides the family; within it one machine for each pair of languages votes
(ties: the larger sum of margins, then the name). Families are those of ``FAMILIES``; a
language that is not listed is a family of its own.

The machines are fitted on a bounded sample: at most ``per_language`` labelled rows of each
language (``family_rows`` of all languages for a machine of a family), those with the least hashes of their ids. Rows that are held out, without language
or without a letter teach nothing. A text that is null or has no letter gets ``und`` and score
0; so does every text if nothing could be learned. Texts are scored whole; repeated rows are
scored alike; other columns are not read. The score is the product of logistic values of the
margins by which family and language won.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signbridge.llm.common import array_slices, fits, fresh, give_back, held_out, stored, text_slices
from signbridge.llm.linear import gram_counts, gram_means, letters, svm

# Language families by ISO 639-1 code.
FAMILIES = {
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "germanic": "af da de en is lb nb nl nn no sv",
    "hellenic": "el",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "romance": "ca es fr gl it la oc pt ro",
    "semitic": "ar he mt",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
}
UNKNOWN = "und"
ORDERS = (2, 3, 4)
BITS = 13
PER_LANGUAGE = 500
FAMILY_ROWS = 2000
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), f"of {lang}")


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled rows (text, lang, nth) of each language, by hash of the id."""
    teach = ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where(teach).select("doc_id", "lang").distinct().withColumn("_nth", F.row_number().over(order))
    ids = ids.where(F.col("_nth") <= per_language).select("doc_id", "lang", "_nth")
    if fits(ids, 32 << 20):
        ids = F.broadcast(ids)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"])
    return rows.select("text", "lang", F.col("_nth").alias("nth"))


class Model:
    """weights (slots x machines), intercepts, and which machine is what."""

    def __init__(self, langs: list[str]) -> None:
        self.families = sorted({family_of(lang) for lang in langs})
        self.members = {f: sorted({lang for lang in langs if family_of(lang) == f}) for f in self.families}
        several = self.families if len(self.families) > 1 else []
        pairs = [p for f in self.families for p in itertools.combinations(self.members[f], 2)]
        self.family_machines = list(range(len(several)))
        self.pair_machines = {p: len(several) + i for i, p in enumerate(pairs)}
        # for each machine the languages on its positive and on its negative side
        self.sides = [(self.members[f], [lang for g in several if g != f for lang in self.members[g]]) for f in several]
        self.sides += [([a], [b]) for a, b in pairs]
        self.weights = np.zeros((1 << BITS, len(self.sides)), np.float32)
        self.intercepts = np.zeros(len(self.sides))

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return gram_means(raw, offsets, ORDERS, BITS, self.weights) + self.intercepts

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        margins = self.margins(raw, offsets)
        logistic = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
        n = len(offsets) - 1
        if self.family_machines:
            by_family = margins[:, self.family_machines]
            best = by_family.argmax(1)
            score = logistic(by_family.max(1))
        else:
            best, score = np.zeros(n, np.int64), np.ones(n)
        out = np.empty(n, object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            members = self.members[f]
            votes, sums, worst = (np.zeros((len(rows), len(members))) for _ in range(3))
            worst += np.inf
            for p, q in itertools.combinations(range(len(members)), 2):
                m = margins[rows, self.pair_machines[members[p], members[q]]]
                for k, own in ((p, m), (q, -m)):
                    votes[:, k] += (own > 0) | ((own == 0) & (k == p))
                    sums[:, k] += own
                    worst[:, k] = np.minimum(worst[:, k], own)
            won = np.lexsort((sums, votes), axis=1)[:, -1] if len(members) > 1 else np.zeros(len(rows), np.int64)
            out[rows] = np.array(members, object)[won]
            if len(members) > 1:
                score[rows] *= logistic(worst[np.arange(len(rows)), won])
        return out.tolist(), score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, family_rows: int = FAMILY_ROWS) -> bytes | None:
    """The pickled model, learned from the bounded sample; None if it is empty. Each machine is fitted in a task of its
    own, on the rows of two languages, or on ``family_rows`` of all languages together (one of each at least)."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            known = [bool(_LETTER.search(t)) for t in batch.column("text").to_pylist()]
            batch = batch.filter(pa.array(known))
            counts = gram_counts(*letters(batch.column("text")), ORDERS, BITS)
            used = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([
                batch.column("lang"), batch.column("nth"), pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())),
                pa.array([c[u].astype(np.int32) for c, u in zip(counts, used, strict=True)], pa.list_(pa.int32())),
                pa.array([int(c.sum()) for c in counts], pa.int64())], ["lang", "nth", "slots", "counts", "total"])

    rows = sample(docs, per_language).mapInArrow(count, "lang string, nth int, slots array<int>, counts array<int>, total long")
    rows = stored(rows, "language-sample")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    model = Model(langs)
    if not model.sides:
        return pickle.dumps(model)
    # the mean share of each slot, in integers, so that the order of the sum makes no difference
    shares = rows.select("total", F.explode(F.arrays_zip("slots", "counts")).alias("e"))
    shares = shares.groupBy(F.col("e.slots").alias("slot")).agg(F.sum(F.expr("(e.counts * 1000000000L) div total")).alias("share")).toArrow()
    mean = np.zeros(1 << BITS)
    mean[shares.column("slot").to_numpy()] = shares.column("share").to_numpy() / 1e9 / max(1, rows.count())
    scale = 1 / np.sqrt(mean + 1e-7)  # rare n-grams weigh as much as frequent ones
    shared = spark.sparkContext.broadcast(scale)
    most = max(1, family_rows // len(langs))
    wanted = [(m, lang, positive, most if m in model.family_machines else per_language)
              for m, sides in enumerate(model.sides) for positive, side in zip((True, False), sides, strict=True) for lang in side]
    fields = [("machine", pa.int32()), ("lang", pa.string()), ("positive", pa.bool_()), ("most", pa.int32())]
    wanted = spark.createDataFrame(pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*wanted, strict=True), fields, strict=True)],
                                            names=[n for n, _ in fields]))
    tasks = rows.join(F.broadcast(wanted), "lang").where(F.col("nth") <= F.col("most"))
    tasks = tasks.select("machine", "lang", "nth", "positive", "slots", "counts", "total")
    tasks = tasks.repartition(len(model.sides), "machine").sortWithinPartitions("machine", "lang", "nth", "total", F.xxhash64("slots", "counts"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, columns, values, positive = None, [], [], []

        def learned() -> pa.RecordBatch:
            x = np.zeros((len(columns), (1 << BITS) + 1), np.float32)
            x[:, -1] = 1
            for row in range(len(columns)):
                x[row, columns.pop(0)] = values.pop(0)
            sides = np.array(positive)
            even = np.where(sides, 1 / max(1, sides.sum()), 1 / max(1, (~sides).sum()))  # classes weigh the same
            w, b = svm(x, np.where(sides, 1, -1), even, ones=True)
            return pa.RecordBatch.from_arrays([pa.array([machine], pa.int32()), pa.array([(w * shared.value).astype(np.float32).tobytes()], pa.binary()),
                                               pa.array([b], pa.float64())], ["machine", "weights", "intercept"])

        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column("machine")[k].as_py()
                if now != machine and columns:
                    yield learned()
                    positive = []
                machine = now
                slots, counts = (batch.column(c)[k].values.to_numpy() for c in ("slots", "counts"))
                columns.append(slots.astype(np.int16))
                values.append((counts / max(1, batch.column("total")[k].as_py()) * shared.value[slots]).astype(np.float32))
                positive.append(batch.column("positive")[k].as_py())
        if columns:
            yield learned()
        give_back()

    for r in tasks.mapInArrow(learn, "machine int, weights binary, intercept double").collect():
        model.weights[:, r["machine"]] = np.frombuffer(r["weights"], np.float32)
        model.intercepts[r["machine"]] = r["intercept"]
    shared.destroy()
    return pickle.dumps(model)


def _no_letter(part: pa.Array) -> list[bool]:
    return [not t or not _LETTER.search(t) for t in part.to_pylist()]


def has_letter(text: Column) -> Column:
    """Whether each text has a letter; false for null."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([not no for part in array_slices(column) for no in _no_letter(part)], pa.bool_())

    return F.arrow_udf(run, "boolean")(text.cast("string"))


def predicted(text: Column, model: bytes | None) -> Column:
    """Struct of lang_pred and score for each text."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machines = pickle.loads(shared.value) if shared.value else None
        for column in columns:
            langs, scores = [], []
            for part in array_slices(column):
                none = _no_letter(part)
                found, score = machines.predict(*letters(part)) if machines else ([UNKNOWN] * len(part), np.zeros(len(part)))
                langs += [UNKNOWN if no else lang for lang, no in zip(found, none, strict=True)]
                scores += np.where(none, 0.0, score).tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")(text.cast("string"))


def predict(docs: DataFrame, model: bytes | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score."""
    return docs.select(doc_id, predicted(F.col(text), model).alias("_p")).select(doc_id, "_p.lang_pred", "_p.score")


def keep_known(docs: DataFrame, model: bytes | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und``; all others stay as they are. Without a model, which
    knows no language, only null texts and texts without a letter are rejected.

    A low margin is no reason to reject a text: those in two of the known languages have the lowest margins of all."""
    if model is None:
        return docs.where(has_letter(F.col(text)))
    name = fresh(docs, "_predicted")
    return docs.withColumn(name, predicted(F.col(text), model)).where(F.col(name)["lang_pred"] != UNKNOWN).drop(name)
