"""Language, toxicity and quality: held-out accuracy, and rows that models trip over."""

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signbridge.llm import language, linear, quality, toxicity
from signbridge.llm.common import held_out, least_hashed, table, text_arrays

SF = "/root/testdata/sf0.01"
ODD = [(90001, None), (90002, ""), (90003, "123 ... !!"), (None, "the of and in"), (90004, "words " * 60000), (90005, "漢字"), (90005, "漢字")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(a, b, 0.5, "x", "y") for a, b in ODD], "doc_id long, text string, score double, _predicted string, _score string")


def test_held_out_rule(spark):
    out = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in out)
    assert spark.sql("select cast(null as bigint) id").select(held_out(F.col("id"))).first()[0]


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 20)).astype(np.float32)
    y = np.where(x[:, 3] - 0.5 * x[:, 7] + 0.2 > 0, 1, -1)
    w, b = linear.svm(x, y, np.ones(300))
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def test_gram_means_are_means_of_counts():
    raw, at = linear.letters(pa.array(["Ab c", None, "x", "hello world"]))
    weights = np.random.default_rng(1).normal(size=(1 << 8, 2))
    counts = np.stack(linear.gram_counts(raw, at, (2, 3), 8))
    want = counts @ weights / np.maximum(counts.sum(1, keepdims=True), 1)
    assert np.allclose(linear.gram_means(raw, at, (2, 3), 8, weights), want)


def test_language(spark, docs, odd):
    model = language.fit(docs)
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    got = language.predict(odd, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (90001, 90002, 90003)) and 0 <= r.score <= 1
    kept = language.keep_known(odd, model)
    assert kept.columns == odd.columns and kept.count() == 4 and {r["_predicted"] for r in kept.collect()} == {"x"}
    # of the corpus nothing is lost, texts in two languages included
    assert language.keep_known(docs, model).count() == docs.where(language.has_letter(F.col("text"))).count()


def test_many_languages_in_one_family(spark):
    """Families of one and of several languages; a machine learns from a bounded number of rows."""
    words = {"en": "the house and garden ", "de": "das haus und garten ", "fr": "la maison et le jardin ", "xx": "zork blip mavu tolo ", "es": "la casa y el patio "}
    rows = [(i * 10 + k, w * (3 + i % 5) + str(i), lang) for k, (lang, w) in enumerate(words.items()) for i in range(40)]
    docs = spark.createDataFrame([*rows, (9999, "lost", None), (None, "nobody", "en")], "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=20, family_rows=50)
    out = language.predict(docs, model).join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    assert out.count() == len(rows) and out.where("lang <> lang_pred").count() == 0
    assert language.fit(docs.where("lang = 'en'")) is not None  # one language alone needs no machine


def test_language_without_enough(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.fit(empty) is None
    assert language.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    one = spark.createDataFrame([(i, "hello there", "en") for i in range(20)] + [(30, "x", None), (31, "--", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(one, language.fit(one)).collect()} == {"en", "und"}


def test_family_first_then_language(spark):
    texts = {"en": "the of and with this that", "de": "der die und mit nicht ein", "es": "el la y con para que", "xx": "qq zz qz zq qqz zzq"}
    langs = [lang for lang in texts for _ in range(20)]
    docs = spark.createDataFrame([(i, f"{texts[lang]} {lang}{i}", lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string")
    model = pickle.loads(language.fit(docs))
    assert model.families == ["germanic", "of xx", "romance"]
    assert list(model.pair_machines) == [("de", "en")]
    assert model.predict(*linear.letters(pa.array(list(texts.values()))))[0] == list(texts)


def test_toxicity(spark, docs, odd):
    labels = table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert out[out.toxic == 0].predicted.mean() < 0.05
    assert out[out.toxic == 1].score.mean() > out[out.toxic == 0].score.mean() + 0.3
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[90001].score == got[90002].score == got[90003].score < 0.5
    kept = toxicity.keep_ordinary(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_toxicity_counts_against_brute_force(spark):
    texts = ["a b a c", "B a. b", None, "", "c é é a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs = set()
    for t in texts:
        w = ["^", *(t or "").lower().replace(".", " ").split()]
        pairs |= set(zip(w[:-1], w[1:]))
    names = ["a", "b", "é", "zz"]
    hashes = [int(toxicity.tokens(pa.array([n]))[0][0]) for n in names]
    order = np.argsort(hashes)
    shared, everything = toxicity.shared_counts(docs, np.array(hashes, np.uint64)[order])
    assert [int(x) for x in shared] == [sum(p[1] == names[i] for p in pairs) for i in order]
    assert everything == len(pairs)
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "toxic int, text string")
    got = {r.word & (2**64 - 1): (r.ordinary, r.toxic) for r in toxicity.class_counts(rows).collect()}
    assert got[hashes[0]] == (3, 1)  # after b, start and é; after b


def test_toxicity_without_labels(spark, docs, odd):
    labels = table(spark, SF, "labels")
    for none in (labels.where("false"), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.fit(docs, none) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.fit(docs.where("false"), labels) is None


def test_quality(spark, docs, odd):
    labels = table(spark, SF, "labels")
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    model = quality.fit(docs, ratings)
    out = quality.rate(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert out[out.quality == 1].selected.mean() > 0.97 and out[out.quality == 0].selected.mean() < 0.4
    got = {r.doc_id: r for r in quality.rate(odd, model).collect()}
    assert got[90001].p_grade == got[90002].p_grade == 0 and not got[90001].selected
    assert all(0 <= r.p_grade <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())


def test_quality_thresholds_are_ordered():
    rng = np.random.default_rng(2)
    counts = rng.poisson(2, (400, 1 << 6)).astype(np.float32)
    f = (counts[:, 3] - counts[:, 9]) / counts.sum(1) * 100
    grades = np.digitize(f, [-2, 0, 2])
    model = quality.Model(grades, counts, np.zeros(400), {g: float((grades == g).sum()) for g in range(4)})
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    guess = (counts / counts.sum(1, keepdims=True)) @ model.weights[:, 0]
    assert np.corrcoef(guess, f)[0, 1] > 0.9


def test_repeats():
    raw, at = text_arrays(pa.array(["a a a b", "", "x", None, "b b c c", "c d"]))
    assert quality.repeats(raw, at).tolist() == [2 / 3, 0, 0, 0, 2 / 3, 0]


def test_quality_with_one_grade(spark, docs):
    ratings = spark.createDataFrame([(i, 2) for i in range(20)] + [(None, 1), (21, None)], "doc_id long, grade int")
    out = quality.rate(docs, quality.fit(docs, ratings)).agg(F.min("expected_grade"), F.max("p_grade")).first()
    assert tuple(out) == (2.0, 1.0)
    assert quality.rate(docs, quality.fit(docs, ratings.where("false"))).agg(F.max("expected_grade")).first()[0] == 0.0


def test_least_hashed_rows_of_each_group(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("g"))
    got = least_hashed(rows, ["g"], F.col("g") * 100 + 7)
    order = rows.withColumn("h", F.xxhash64("doc_id")).collect()
    want = {r.doc_id for g in range(3) for r in sorted((r for r in order if r.g == g), key=lambda r: r.h)[: g * 100 + 7]}
    assert {r.doc_id for r in got.collect()} == want and got.columns == rows.columns
    assert least_hashed(rows.where("false"), ["g"], F.lit(5)).count() == 0
