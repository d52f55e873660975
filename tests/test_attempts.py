"""Answers asked for again, embeddings kept in a store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signbridge.operators import attempts as at
from signbridge.operators import embed as eb
from signbridge.operators import embedding_store as es
from signbridge.operators import vocab as vc
from signbridge.plans import jobs


@pytest.fixture
def prompts(spark):
    rows = [(1, "go # stay"), (2, "a # a # a # a # a # a"), (3, "go # <unk>"), (4, None), (5, ""), (None, "x # <unk>")]
    return spark.createDataFrame(rows, "q_id long, text string")


def _asker(log):
    def ask(rows, params):
        log.append((params, sorted((r["q_id"] or 0) for r in rows.collect())))
        second = "presence_penalty" in params
        return rows.where("text is not null").select("q_id", (F.concat(F.lit("again "), "q_id") if second else F.col("text")).alias("answer"))
    return ask


def _asked(log, attempt):
    return sorted(q for params, ids in log for q in ids if params == at.ATTEMPT_PARAMS[attempt])


def test_attempts(prompts, tmp_dir):
    log = []
    attempts = at.ask_with_retries(prompts, _asker(log), tmp_dir, parts=3)
    assert _asked(log, 0) == [0, 1, 2, 3, 4, 5] and _asked(log, 1) == [0, 2, 3, 4]
    last = {r["q_id"]: (r["answer"], r["needs_retry"], r["attempts"]) for r in at.last_answers(attempts).collect()}
    assert last == {1: ("go # stay", False, 1), 2: ("again 2", False, 2), 3: ("again 3", False, 2), 4: (None, True, 2),
                    5: ("", False, 1), None: (None, True, 2)}
    # a second run asks nothing, and other prompts only in the parts that changed
    again = at.ask_with_retries(prompts, _asker(rerun := []), tmp_dir, parts=3)
    assert rerun == [] and sorted(map(str, again.collect())) == sorted(map(str, attempts.collect()))


def test_attempts_go_on_after_a_failure(prompts, tmp_dir):
    log, calls = [], []

    def dies(rows, params):
        if len(calls) == 2:
            raise RuntimeError("gone")
        calls.append(1)
        return _asker(log)(rows, params)

    with pytest.raises(RuntimeError):
        at.ask_with_retries(prompts, dies, tmp_dir, parts=4)
    at.ask_with_retries(prompts, _asker(log), tmp_dir, parts=4)
    assert _asked(log, 0) == [0, 1, 2, 3, 4, 5] and _asked(log, 1) == [0, 2, 3, 4]  # each once


def test_no_prompts(prompts, tmp_dir):
    log = []
    out = at.last_answers(at.ask_with_retries(prompts.limit(0), _asker(log), tmp_dir))
    assert out.count() == 0 and out.columns == ["q_id", "answer", "needs_retry", "attempts"] and log == []


def test_last_answers_are_grounded(spark, tmp_dir):
    corpus = spark.createDataFrame([(0, "go|leave", "M518x529S14c20481x471"), (1, "stay", "M500x500S38800464x496")],
                                   "row_id long, word string, fsw string")
    emb = eb.hashing_embedder(16)
    vocab = jobs.build_vocabulary(corpus, emb)
    ask = lambda rows, params: rows.select("q_id", F.lit("stay" if "presence_penalty" in params else "<unk>").alias("answer"))
    out = jobs.ask_and_ground(spark.range(1).select(F.col("id").alias("q_id")), ask, vocab, tmp_dir, emb).first()
    assert (out["units"], out["joint_prob"], out["attempts"], out["needs_retry"]) == ("stay", 1.0, 2, False)


def _counting(spark):
    asked = spark.sparkContext.accumulator(0)

    def fn(texts):
        asked.add(len(texts))
        return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)
    return fn, asked


def test_store_embeds_each_text_once(spark, tmp_dir):
    path = f"{tmp_dir}/store"
    fn, asked = _counting(spark)
    rows = spark.createDataFrame([(i, None if i == 9 else "t" * (i % 4)) for i in range(10)], "text_hash long, text string")
    out = es.embed_stored(rows, "text", path, "1", fn)  # a column of the input is named like one of the store
    assert asked.value == 4
    assert {r["text_hash"]: r["embedding"] for r in out.collect()} == {i: None if i == 9 else [i % 4, 1.0] for i in range(10)}
    es.embed_stored(rows, "text", path, "1", fn).collect()
    assert asked.value == 4  # a second run calls the function for nothing
    more = rows.unionByName(spark.createDataFrame([(10, "new"), (11, "new")], rows.schema))
    assert es.embed_stored(more, "text", path, "1", fn).where("embedding is null").count() == 1 and asked.value == 5
    es.embed_stored(rows, "text", path, "other model", fn).collect()
    assert asked.value == 9
    assert es.embed_stored(rows.limit(0), "text", f"{tmp_dir}/none", "1", fn).count() == 0


def test_appended_entries_embedded_once(spark, tmp_dir):
    fn, asked = _counting(spark)
    corpus = spark.createDataFrame([(0, "go|leave", "M518x529S14c20481x471"), (1, "stay", "M500x500S38800464x496")],
                                   "row_id long, word string, fsw string")
    vocab = jobs.build_vocabulary(corpus, fn, store=(tmp_dir + "/s", "m"))
    assert asked.value == 2 and vocab.count() == 2
    units = spark.createDataFrame([("S10000", "<unk>")], "symbol string, word string")
    extended = vc.append_unknown_entries(vocab.drop("embedding"), units, 5)
    for _ in range(2):
        es.embed_stored(extended.where("canonical like 'unk_%'"), "canonical", tmp_dir + "/s", "m", fn).collect()
    assert asked.value == 3
