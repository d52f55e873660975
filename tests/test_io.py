"""File sources and sinks, including the quirky lines of the pair-text format."""

import os

import pytest
from pyspark.sql import functions as F

from signbridge.sinks import writers as wr
from signbridge.sources import files as fs


def test_pair_text_edge_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "pairs.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write('"Go," he said# M518x529S14c20481x471\n')
        f.write("null# M500x500S38800464x496\n")
        f.write("\n")
        f.write("a# b# M500x500S38700463x496\n")
        f.write("no separator here\n")
        f.write('"Go," he said# M518x529S14c20481x471\n')
    pairs, corrupt = fs.read_pair_text(spark, path)
    got = {(r["sentence"], r["fsw"]) for r in pairs.collect()}
    assert got == {('"Go," he said', "M518x529S14c20481x471"), ("null", "M500x500S38800464x496"),
                   ("a# b", "M500x500S38700463x496")}
    assert pairs.count() == 3
    assert sorted(r["value"] for r in corrupt.collect()) == ["", "no separator here"]


def test_lines_keep_blank_and_order(spark, tmp_dir):
    path = os.path.join(tmp_dir, "lines.txt")
    with open(path, "w") as f:
        f.write("one\n\nthree\n")
    rows = fs.read_lines(spark, path).orderBy("row_id").collect()
    assert [(r["row_id"], r["line"]) for r in rows] == [(0, "one"), (1, ""), (2, "three")]


def test_corpus_sink_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("this|that", "M510x527S10004495x473")], "word string, fsw string")
    out = os.path.join(tmp_dir, "corpus")
    wr.write_pair_text(wr.with_corpus_constants(df), out, "word", "fsw")
    back, corrupt = fs.read_pair_text(spark, out, "word", "fsw")
    assert back.count() == 7 and corrupt.count() == 0
    assert ("Full stop|.", "M500x500S38800464x496") in {(r["word"], r["fsw"]) for r in back.collect()}


def test_build_if_absent(spark, tmp_dir):
    out = os.path.join(tmp_dir, "stage")
    first = wr.build_if_absent(spark, out, lambda: spark.createDataFrame([(1,)], "a int"))
    second = wr.build_if_absent(spark, out, lambda: spark.createDataFrame([(2,)], "a int"))
    assert [r[0] for r in first.collect()] == [1] and [r[0] for r in second.collect()] == [1]


def test_json_vocabulary(spark, tmp_dir):
    path = os.path.join(tmp_dir, "vocab.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write('[{"id": 0, "symbol": "S10004 S22a04", "word": ["this", "ça"], '
                '"fsw": ["M510x527S10004495x473S22a04490x512"], "embedding": [0.5, 0.25]}]')
    r = fs.read_json_array(spark, path).first()
    assert r["word"] == ["this", "ça"] and r["embedding"] == [0.5, 0.25]


def test_csv_source(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bank.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("spoken_language,sign_language,Sentence/Sign,annotated_texts_multilingual,sign_writing\n")
        f.write(' en ,ase,Sign,"hello᛫hi᛫Hello",M510x527S10004495x473\n')
        f.write('en,ase,Sentence,"Go, now᛫Leave",M518x529S14c20481x471\n')
        f.write("fr,ase,Sign,bonjour,M500x500S38800464x496\n")
    from signbridge.plans import jobs
    raw = fs.read_csv(spark, path, fs.SIGNBANK_SCHEMA)
    signs = jobs.prepare_corpus(raw, jobs.KIND_SIGN).collect()
    assert [(r["word"], r["fsw"]) for r in signs] == [("hello|hi", "M510x527S10004495x473")]
    sents = jobs.prepare_corpus(raw, jobs.KIND_SENTENCE).collect()
    assert [(r["sentence"], r["word"], r["split"]) for r in sents] == [("Go, now", "go, now", "test")]


def test_sentence_text_stays_as_it_is(spark):
    rows = [(0, "en", "ase", "Sentence", "The Lord said: Go|Now|Then᛫other", "M500x500S38800464x496")]
    raw = spark.createDataFrame(rows, "row_id long, spoken_language string, sign_language string, `Sentence/Sign` string, "
                                      "annotated_texts_multilingual string, sign_writing string")
    from signbridge.plans import jobs
    r = jobs.prepare_corpus(raw, jobs.KIND_SENTENCE).first()
    assert (r["sentence"], r["word"]) == ("The Lord said: Go|Now|Then", "the lord said: go|now")


def test_pair_lines_with_other_line_ends(spark, tmp_dir):
    path = os.path.join(tmp_dir, "pairs.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write("a\u2028b# M500x500S38800464x496\nc\u0085d# S1\u2028\n")
    pairs, corrupt = fs.read_pair_text(spark, path)
    assert {(r["sentence"], r["fsw"]) for r in pairs.collect()} == {("a\u2028b", "M500x500S38800464x496"), ("c\u0085d", "S1\u2028")}
    assert corrupt.count() == 0


def test_stage_is_built_once(spark, tmp_dir):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1,)], "a int")

    for _ in range(3):
        assert wr.build_if_absent(spark, os.path.join(tmp_dir, "once"), build).count() == 1
    assert calls == [1]


def test_reports(spark):
    d = spark.createDataFrame([(False, 10, 20, 4, 2.5, 5.0)], "ordered boolean, total_x long, total_y long, tokens long, mean_x double, mean_y double")
    lines = [r["value"] for r in wr.distance_block(d).orderBy("line").collect()]
    assert lines == ["======NOT ORDERED FACTOR======", "", "X coordinates:", "total distance: 10", "token number: 4", "mean distance: 2.5", "",
                     "Y coordinates:", "total distance: 20", "token number: 4", "mean distance: 5.0", ""]
    assert wr.mean_line(spark.createDataFrame([(0.5,), (0.25,)], "f1 double")).first()[0] == "Mean F1: 0.375"
    p = spark.createDataFrame([(3, "a", "b", 1.005, 20.0)], "row_id long, hyp string, ref string, bleu double, chrf double")
    assert wr.line_report(p).first()["value"].startswith("Line 3:\nGold: b\nPred: a\nBLEU: 1.0")


def test_line_aligned_and_space_separated_sinks(spark, tmp_dir):
    df = spark.createDataFrame([(2, "c", "S3"), (0, "a", "S1"), (1, "b", None)], "row_id long, sentence string, symbol string")
    wide = os.path.join(tmp_dir, "wide")
    wr.write_line_aligned(df, wide, ["sentence", "symbol"])
    assert [r["sentence"] for r in spark.read.parquet(wide).orderBy("row_id").collect()] == ["a", "b", "c"]
    lines = os.path.join(tmp_dir, "symbols")
    wr.write_column_lines(df, lines, "symbol")
    got = []
    for name in sorted(os.listdir(lines)):
        if name.startswith("part-"):
            with open(os.path.join(lines, name), encoding="utf-8") as f:
                got.extend(f.read().splitlines())
    assert got == ["S1", "", "S3"]
    spaced = os.path.join(tmp_dir, "spaced")
    wr.write_csv(df.select("sentence", "symbol").where("symbol is not null"), spaced, header=False, sep=" ")
    assert sorted(r[0] for r in spark.read.text(spaced).collect()) == ["a S1", "c S3"]


def test_sql_over_registered_views(spark):
    from signbridge.sources.tables import register_views
    register_views(spark, "/root/testdata/sf0.001")
    n = spark.sql("select count(*) from signs s join corpus c on s.k = c.p_partkey").first()[0]
    assert n > 0


def test_stage_is_built_again_after_a_build_that_died(spark, tmp_dir):
    out, calls = os.path.join(tmp_dir, "stage"), []

    def build():
        calls.append(1)
        if len(calls) == 1:  # fails in the middle of writing
            return spark.range(1000).selectExpr("if(id = 999, raise_error('lost'), id) as id").repartition(4)
        return spark.range(1000)

    with pytest.raises(Exception, match="lost"):
        wr.build_stage(spark, out, build)
    assert wr.build_stage(spark, out, build).count() == 1000 and len(calls) == 2
    assert wr.build_stage(spark, out, build).count() == 1000 and len(calls) == 2
    record = spark.read.parquet(f"{out}/commits").collect()
    assert [(r["rows"], r["params"], r["sources"]) for r in record] == [(1000, "{}", "")]


def test_stage_is_built_again_for_other_inputs_or_parameters(spark, tmp_dir):
    source, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "stage")
    spark.range(5).write.parquet(source)
    stage = lambda **p: wr.build_stage(spark, out, lambda: spark.read.parquet(source).withColumn("p", F.lit(str(p))), inputs=[source], params=p)
    assert stage(seed=1).count() == 5 and stage(seed=2).select("p").first()[0] == "{'seed': 2}"
    assert stage(seed=1).select("p").first()[0] == "{'seed': 1}"
    assert spark.read.parquet(f"{out}/commits").count() == 2
    spark.range(3).write.mode("append").parquet(source)
    assert stage(seed=1).count() == 8 and spark.read.parquet(f"{out}/commits").count() == 3


def test_empty_stage(spark, tmp_dir):
    stage = lambda: wr.build_stage(spark, os.path.join(tmp_dir, "none"), lambda: spark.range(0))
    assert stage().count() == 0 and stage().columns == ["id"]


def test_csv_fields_come_back_as_they_were(spark, tmp_path):
    """Quotes, separators, line ends, outer blanks, backslashes, empty and null fields; rows are numbered."""
    texts = ['say "no", twice', " outer blanks ", "two\nlines\r\nand more", "back\\slash\\", '"', "", None, "a|b # c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string").repartition(3)
    for sep, header in ((",", True), (" ", False)):
        path = str(tmp_path / f"out{header}")
        wr.write_csv(df, path, header=header, sep=sep)
        back = fs.read_csv(spark, path, df.schema, header=header, sep=sep).orderBy("n").collect()
        assert [r["text"] for r in back] == [t or None for t in texts]
        assert sorted(r["row_id"] for r in back) == list(range(len(texts)))
