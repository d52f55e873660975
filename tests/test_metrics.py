"""Metric formulas: golden arithmetic from published outputs and hand cases."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from signbridge.operators import metrics as mt

# Published sign->text baseline evaluations: precisions, brevity inputs and scores.
PUBLISHED_BLEU = [
    ((47.0, 24.3, 15.3, 10.1), 9032, 9990, 18.4),
    ((31.5, 11.8, 7.1, 4.1), 8388, 9990, 8.4),
    ((23.8, 3.2, 0.9, 0.4), 9798, 9990, 2.2),
]
# Published per-row set metrics (precision, recall, f1) of a text->sign run.
PUBLISHED_F1_ROWS = [(0.2889, 0.1757, 0.2185), (0.4333, 0.3250, 0.3714), (0.4478, 0.5172, 0.4800),
                     (0.1964, 0.2558, 0.2222), (0.2000, 0.2162, 0.2078), (0.9412, 0.8889, 0.9143)]
# Published distance totals: (total, tokens, mean).
PUBLISHED_DISTANCES = [(1162883, 40557, 28.67280617402668), (1198365, 40557, 29.547673644500332),
                       (1015016, 40557, 25.026900411766157), (1202933, 40557, 29.660305249402075)]


def _bleu(spark, fields, **kw):
    names = [f"m{i}" for i in range(1, 5)] + [f"t{i}" for i in range(1, 5)] + ["hyp_len", "ref_len"]
    df = spark.createDataFrame([fields], ", ".join(f"{n} long" for n in names))
    return df.select(mt.bleu_score(F.struct(*names), **kw)).first()[0]


def test_bleu_from_published_precisions(spark):
    for precs, hyp, ref, score in PUBLISHED_BLEU:
        total = 100_000  # the printed precisions as counts of so many n-grams
        matches = [round(p * total / 100) for p in precs]
        assert abs(round(_bleu(spark, (*matches, *[total] * 4, hyp, ref)), 1) - score) < 0.051


def test_f1_from_published_rows(spark):
    df = spark.createDataFrame(PUBLISHED_F1_ROWS, "p double, r double, f double")
    assert all(abs(r[0] - r[1]) < 1e-4 for r in df.select(mt.f1_of(F.col("p"), F.col("r")), "f").collect())


def test_distance_means(spark):
    for total, tokens, mean in PUBLISHED_DISTANCES:
        # a line for each token, all of the distance on the first
        first = F.col("id") == 0
        pairs = spark.range(tokens).select(F.array(F.when(first, F.lit(total)).otherwise(7)).alias("p"),
                                           F.array(F.when(first, F.lit(0)).otherwise(7)).alias("g"))
        r = mt.distance_totals(pairs, "p", "g", "p", "g").first()
        assert (r["total_x"], r["tokens"], r["mean_x"], r["mean_y"]) == (total, tokens, mean, mean)


def test_bleu_without_matches(spark):
    pairs = spark.createDataFrame([(0, "a b c d e", "v w x y z"), (1, "a b", "a b")], "row_id long, hyp string, ref string")
    got = {r["row_id"]: r["bleu"] for r in mt.sentence_bleu(pairs).collect()}
    assert got[0] == 0.0 and abs(got[1] - 100) < 1e-9
    short = pairs.where("row_id = 1")
    assert abs(mt.corpus_bleu(short).first()["bleu"] - 100) < 1e-9
    assert mt.corpus_bleu(short, effective_order=False).first()["bleu"] == 0.0


def test_unequal_lines_are_an_error(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "row_id long, p string")
    b = spark.createDataFrame([(0, "x"), (2, "z")], "row_id long, g string")
    with pytest.raises(Exception, match="line on one side only"):
        mt.align_by_position(a, b, enforce=True).collect()
    same = a.withColumnRenamed("p", "g")
    assert mt.align_by_position(a, same, enforce=True).count() == 2


def test_set_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], ["a"]), (["a"], [])],
                               "p array<string>, g array<string>")
    rows = mt.with_set_metrics(df, "p", "g").collect()
    assert (rows[0]["precision"], rows[0]["recall"], rows[0]["f1"]) == (0.5, 0.5, 0.5)
    assert rows[1]["f1"] == 0.0 and rows[2]["f1"] == 0.0


def test_padded_distance(spark):
    df = spark.createDataFrame([([500, 10], [490])], "p array<int>, g array<int>")
    r = df.select(mt.padded_distance(F.col("p"), F.col("g")).alias("d"),
                  mt.padded_length(F.col("p"), F.col("g")).alias("n")).first()
    assert (r["d"], r["n"]) == (10 + 472, 2)


def test_tokenizer_13a():
    assert mt.tokenize_13a('He said: "3.5-4, ok." &amp; left') == \
        ["He", "said", ":", '"', "3.5", "-", "4", ",", "ok", ".", '"', "&", "left"]


def test_bleu_hand_cases(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"),
                                ("the cat", "the cat sat on the mat"),
                                ("", "ref")], "hyp string, ref string")
    rows = df.select(mt.bleu_score(mt.bleu_stats("hyp", "ref")).alias("b")).collect()
    assert abs(rows[0]["b"] - 100.0) < 1e-9
    # effective order 1: unigram precision 100, BP = exp(1 - 6/2)
    assert abs(rows[1]["b"] - 100 * math.exp(1 - 3)) < 1e-9
    assert rows[2]["b"] == 0.0


def test_chrf_hand_cases(spark):
    df = spark.createDataFrame([("abc", "abc"), ("ab", "abc"), ("", "x")], "hyp string, ref string")
    rows = df.select(mt.chrf_score(mt.chrf_stats("hyp", "ref")).alias("c")).collect()
    assert abs(rows[0]["c"] - 100.0) < 1e-9
    # orders 1-2 exist on both sides: P = 1, R = (2/3 + 1/2) / 2
    p, r = 1.0, (2 / 3 + 1 / 2) / 2
    assert abs(rows[1]["c"] - 100 * 5 * p * r / (4 * p + r)) < 1e-9
    assert rows[2]["c"] == 0.0


def test_corpus_includes_blank_lines_sentence_skips_them(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("", "e f")], "hyp string, ref string")
    assert mt.sentence_bleu(df).count() == 1
    c = mt.corpus_bleu(df).first()
    assert (c["hyp_len"], c["ref_len"]) == (4, 6)


def test_alignment_report(spark):
    a = spark.createDataFrame([(0,), (1,), (2,)], "row_id long")
    b = spark.createDataFrame([(0,), (1,), (5,)], "row_id long")
    r = mt.alignment_report(a, b).first()
    assert (r["n_pred"], r["n_gold"], r["pred_only"], r["gold_only"], r["aligned"]) == (3, 3, 1, 1, False)


def _python_stages(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_evaluation_compares_each_pair_once(spark):
    """Reports read stored statistics: none goes through Python again, and all equal the separate jobs."""
    from signbridge.plans import jobs
    pairs = spark.createDataFrame([(1, "a B c\nd", "a b c d", 7), (2, None, "x", 8), (3, "q", None, 9), (4, "the cat sat on it", "the cat sat on it", 0)],
                                  "row_id long, pseudo_sentence string, sentence string, stats int")
    out = jobs.evaluate_text(pairs)
    assert [_python_stages(df) for df in out.values()] == [0, 0, 0]
    plain = spark.createDataFrame([("a B c d", "a b c d"), ("", "x"), ("q", ""), ("the cat sat on it",) * 2], "hyp string, ref string")
    assert out["bleu"].first() == mt.corpus_bleu(plain).first() and out["chrf"].first() == mt.corpus_chrf(plain).first()
    lines = {r["ref"]: (r["bleu"], r["chrf"], r["stats"]) for r in out["per_line"].collect()}
    single = {r["ref"]: (r["bleu"], r["chrf"]) for r in mt.sentence_chrf(mt.sentence_bleu(plain)).collect()}
    assert {k: v[:2] for k, v in lines.items()} == single and {v[2] for v in lines.values()} == {7, 0}
    assert jobs.evaluate_text(pairs.limit(0))["bleu"].count() == 1
    signs = spark.createDataFrame([(0, "M518x529S14c20481x471S27106503x489", "M518x529S27106503x489S14c20481x471"), (1, None, "M500x500S38800464x496")],
                                  "row_id long, pred_fsw_seq string, gold_fsw_seq string")
    assert [_python_stages(df) for df in jobs.evaluate_signs(signs).values()] == [0] * 7


def plain_counts(hyp, ref, orders):
    """Per order: n-grams of both sides and the clipped matches, counted one by one."""
    out = []
    for n in range(1, orders + 1):
        h, r = (Counter(tuple(x[i: i + n]) for i in range(len(x) - n + 1)) for x in (hyp, ref))
        out.append((sum(h.values()), sum(r.values()), sum((h & r).values())))
    return out


def test_rows_counted_together():
    """Many pairs in one sort, over several parts; symbols that do not fit a key; capitals that matter or not."""
    rng = random.Random(7)
    alphabets = ["ab .", "S0123 x", "aAbB&,-5.\n", "\u0130\u03a3\u03c3\u00df\U0001f600\0 ", "".join(map(chr, range(0x4e00, 0x5e00)))]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.choice([0, 1, 2, 5, 9, 60, 400]))) for _ in range(600)]
    texts += [" ".join(f"w{i}" for i in rng.choices(range(60_000), k=45_000)), "".join(map(chr, range(0x4e00, 0x5e00))), None]
    hyps, refs = texts, [rng.choice([t, (t or "")[1:] + "aB", *texts[:3]]) for t in texts]
    bleu, chrf = mt.bleu_rows(hyps, refs).tolist(), mt.chrf_rows_both(hyps, refs).tolist()
    for h, r, b, c in zip(hyps, refs, bleu, chrf):
        words = [mt.tokenize_13a((x or "").strip()) for x in (h, r)]
        want = plain_counts(*words, mt.BLEU_ORDER)
        assert b == [x[2] for x in want] + [x[0] for x in want] + [len(words[0]), len(words[1])]
        for lower, got in ((False, c[:18]), (True, c[18:])):
            sides = ["".join((x or "").split()) for x in (h, r)]
            want = plain_counts(*[x.lower() if lower else x for x in sides], mt.CHRF_ORDER)
            assert got == [x[k] for k in range(3) for x in want]


def test_13a_word_by_word():
    def whole(line):
        line = " " + line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ") + " "
        for rx, repl in mt._13A_RULES:
            line = rx.sub(repl, line)
        return line.split()

    rng = random.Random(8)
    for _ in range(5000):
        line = "".join(rng.choices("ab5.,-;: \n <'\u0663\u00e9/lt~\"_", k=rng.randint(0, 12)))
        assert mt.tokenize_13a(line) == whole(line)


def test_metrics_of_many_short_rows_take_one_sort():
    """A pass in Python over each pair took 1.4 ms a pair."""
    signs = [" ".join(f"B S1{i * k % 40:02x}0{k % 3} S2{i % 7:02x}00" for k in range(1, 6)) for i in range(4000)]
    began = time.process_time()
    mt.bleu_rows(signs, signs[1:] + signs[:1])
    mt.chrf_rows_both(signs, signs[1:] + signs[:1])
    assert time.process_time() - began < 2.5
