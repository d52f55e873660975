"""Composite jobs end to end on hand-made rows in the reference's schemas."""

import numpy as np
from pyspark.sql import functions as F

from signbridge.operators import embed as eb
from signbridge.operators import similarity as sim
from signbridge.operators import vocab as vc
from signbridge.plans import jobs
from signbridge.sinks import writers as wr


def _corpus(spark):
    return spark.createDataFrame([
        (0, "this|that", "M510x527S10004495x473S22a04490x512"),
        (1, "full stop|.", "M500x500S38800464x496"),
        (2, "go|leave", "M518x529S14c20481x471S27106503x489"),
    ], "row_id long, word string, fsw string")


def test_decompose_and_training_sets(spark):
    vocab = jobs.build_vocabulary(_corpus(spark))
    sents = spark.createDataFrame([
        (10, "this stop", "M1x1S22a04490x512S10004495x473 M500x500S38800464x496"),
        (11, "go away", "M518x529S27106503x489S14c20481x471 M500x500S2ff00482x483"),
    ], "row_id long, sentence string, fsw string")
    dec = {r["row_id"]: r for r in jobs.decompose_sentences(sents, vocab).collect()}
    assert dec[10]["word"] == "this|that # full stop|."
    assert dec[11]["word"] == "go|leave # <unk>"
    sets = jobs.build_training_sets(jobs.decompose_sentences(sents, vocab), _corpus(spark).select("word", "fsw"))
    assert sets["filtered"].count() == 1
    assert sets["train_plus_vocab"].count() == 5
    freq, labelled, extended = jobs.profile_unknowns(
        vc.lookup_signs(vc.explode_sequences(sents, "row_id"), vocab).withColumnRenamed(
            "row_id", "sentence_id"), vocab, top_n=1)
    assert freq.count() == 1 and extended.count() == 4


def test_prompts_and_grounding(spark):
    emb = eb.hashing_embedder(16)
    vocab = eb.embed_column(jobs.build_vocabulary(_corpus(spark)), "canonical", emb)
    sentences = spark.createDataFrame([
        (1, "this is it", "this|that"), (2, "stop now", "full stop|. # <unk>"), (3, "", "go|leave")],
        "sentence_id long, sentence string, word string")
    sentences = eb.embed_column(sentences, "sentence", emb)
    queries = eb.embed_column(spark.createDataFrame([(7, "this stops")], "q_id long, text string"), "text", emb) \
        .withColumnRenamed("embedding", "q_vec")
    prompts = jobs.build_prompts(queries, sentences, vocab).first()
    roles = [m["role"] for m in prompts["messages"]]
    # sentence 3 has an empty text: its example pair is skipped
    assert roles == ["system", "user", "assistant", "user", "assistant", "user", "user"]
    assert "this|that" in prompts["messages"][0]["content"]
    s2t = jobs.build_prompts(queries, sentences, vocab, direction="sign2text").first()["messages"]
    assert s2t[1]["content"] in ("this|that", "full stop|. # <unk>")

    answers = spark.createDataFrame([(7, "this|that # full stop|."), (8, "a # a # a # a # a # a")],
                                    "q_id long, answer string")
    g = {r["q_id"]: r for r in jobs.ground_answers(answers, vocab, emb).collect()}
    assert g[7]["units"] == "this|that # full stop|." and g[7]["joint_prob"] == 1.0
    assert g[8]["needs_retry"] and not g[7]["needs_retry"]


def test_join_gold_fans_out(spark):
    pred = spark.createDataFrame([("s", "p1"), ("t", "p2")], "sentence string, pred_fsw_seq string")
    gold = spark.createDataFrame([("s", "F1", "S1", "w1"), ("s", "F2", "S2", "w2")],
                                 "sentence string, fsw string, symbol string, word string")
    assert jobs.join_gold(pred, gold).count() == 2


def test_evaluate_signs_and_text(spark):
    pairs = spark.createDataFrame([
        (0, "M500x500S10004490x490S22a04480x480", "M500x500S22a04480x480S10004490x490"),
        (1, "M500x500S38800464x496", "M500x500S38800464x496 M510x510S10004500x500"),
    ], "row_id long, pred_fsw_seq string, gold_fsw_seq string")
    out = jobs.evaluate_signs(pairs)
    f1 = {r["row_id"]: r["f1"] for r in out["f1_rows"].collect()}
    assert f1[0] == 1.0 and abs(f1[1] - 2 * 1.0 * 0.5 / 1.5) < 1e-12
    dist = {r["ordered"]: r for r in out["distance"].collect()}
    # plain order: row 0 swaps two symbols (10 + 10), row 1 pads the gold's second sign
    # with 482 (|482-510| + |482-500|); sorted symbols make row 0 identical
    assert dist[False]["total_x"] == 10 + 10 + (510 - 482) + (500 - 482) and dist[False]["tokens"] == 3 + 4
    assert dist[True]["total_x"] == (510 - 482) + (500 - 482)
    assert out["bleu"].count() == 2 and {r["ordered"] for r in out["chrf"].collect()} == {False, True}
    text = spark.createDataFrame([("the cat\nsat", "the cat sat"), (None, "x")], "pseudo_sentence string, sentence string")
    t = jobs.evaluate_text(text)
    assert t["bleu"].first()["ref_len"] == 4 and t["per_line"].count() == 1


def test_cosine_and_report_helpers(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(sim.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 1 / np.sqrt(2)) < 1e-12 and got[1] is None
    scored = spark.createDataFrame([(0, 0.28888, 0.17571, 0.21852)], "row_id long, precision double, recall double, f1 double")
    r = wr.metric_report(scored).first()
    assert (r["Row"], r["Precision"], r["Recall"], r["F1"]) == (1, "0.2889", "0.1757", "0.2185")


def test_evaluate_signs_empty_prediction(spark):
    pairs = spark.createDataFrame([(0, "", "M500x500S38800464x496")],
                                  "row_id long, pred_fsw_seq string, gold_fsw_seq string")
    out = jobs.evaluate_signs(pairs)
    assert out["f1_rows"].first()["f1"] == 0.0
    d = {r["ordered"]: r for r in out["distance"].collect()}
    assert d[False]["tokens"] == 2 and d[False]["total_x"] == abs(482 - 500) + abs(482 - 464)


def test_appended_unknowns_never_multiply_signs(spark):
    vocab = jobs.build_vocabulary(_corpus(spark))
    signs = spark.createDataFrame([
        (1, 0, "M500x500S10000480x480S20000490x490"), (1, 1, "M500x500S20000490x490S10000480x480"),
        (2, 0, "M500x500S38800464x496"), (2, 1, "M500x500S10000480x480S20000490x490")], "sentence_id long, pos long, fsw string")
    _, _, extended = jobs.profile_unknowns(vc.lookup_signs(signs, vocab), vocab, 10)
    assert extended.count() == vocab.count() + 2  # two written orders of one key
    got = sorted((r["sentence_id"], r["pos"], r["word"]) for r in vc.lookup_signs(signs, extended).collect())
    assert got == [(1, 0, "unk_1 unk_2"), (1, 1, "unk_1 unk_2"), (2, 0, "full stop|."), (2, 1, "unk_1 unk_2")]


def test_filtered_sample_counts_the_filtered_set(spark):
    rows = [(i, f"s{i}", "F", "x", "<unk>" if i % 5 < 3 else "go", 1, 0) for i in range(1000)]
    dec = spark.createDataFrame(rows, "row_id long, sentence string, fsw string, symbol string, word string, n_signs long, n_unk long")
    sets = jobs.build_training_sets(dec, _corpus(spark).select("word", "fsw"))
    assert sets["filtered"].count() == 400 and sets["filtered_5pct"].count() == 20


def test_gold_join_matches_nulls(spark):
    pred = spark.createDataFrame([(None, "p1"), ("t", "p2")], "sentence string, pred_fsw_seq string")
    gold = spark.createDataFrame([(None, "F", "S", "w"), ("u", "F", "S", "w")], "sentence string, fsw string, symbol string, word string")
    out = jobs.join_gold(pred, gold)
    assert [(r["sentence"], r["pred_fsw_seq"], r["gold_cd"]) for r in out.collect()] == [(None, "p1", "w")]


def test_workers_import_the_package_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from signbridge.session import get_session\nimport __spark_entry__ as e\n"
            "s = get_session('local[2]', 2)\n"
            "print('ROWS', e.queries()['embed_batches'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]


def test_lookup_joins_alike_on_either_side_of_the_bound(spark):
    vocab = jobs.build_vocabulary(_corpus(spark))
    signs = spark.createDataFrame([(i, 0, f) for i, f in enumerate(["M500x500S38800464x496", "M1x1S22a04490x512S10004495x473", "M500x500S2ff00482x483"])],
                                  "sentence_id long, pos long, fsw string")
    small, large = (vc.lookup_signs(signs, vocab, broadcast_bytes=b) for b in (1 << 26, 0))
    assert sorted(map(tuple, small.select(*large.columns).collect())) == sorted(map(tuple, large.collect()))
