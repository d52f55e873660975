"""Canonical forms, vocabulary grouping and the order-free lookup (hand cases)."""

from signbridge.functions import text as tx
from signbridge.operators import vocab as vc


def test_top_two_counted_ties_first_seen(spark):
    df = spark.createDataFrame([(["b", "a", "a", "B ", "c"],), (["x"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(tx.top_two_counted("w")).collect()]
    assert got == ["b|a", "x", ""]


def test_first_two_distinct(spark):
    df = spark.createDataFrame([(["Go ", "go", "LEAVE", "x"],), (["one"],)], "w array<string>")
    assert [r[0] for r in df.select(tx.first_two_distinct("w")).collect()] == ["go|leave", "one"]


def test_grouped_top_two_matches_row_expression(spark):
    rows = [(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "B "), (1, 4, "c"), (2, 0, "z")]
    df = spark.createDataFrame(rows, "g long, o long, w string")
    got = {r["g"]: r["canonical"] for r in vc.top_two_counted(df, ["g"], "w", "o").collect()}
    assert got == {1: "b|a", 2: "z"}


def test_vocabulary_and_lookup(spark):
    corpus = spark.createDataFrame([
        (1, "this|that", "M510x527S10004495x473S22a04490x512"),
        (2, "This|other", "M510x527S22a04490x512S10004495x473"),   # same multiset, other order
        (3, "full stop|.", "M500x500S38800464x496"),
        (4, "full stop|.", "M500x500S38800464x496"),                # duplicate row: dropped
    ], "row_id long, word string, fsw string")
    vocab = vc.build_vocabulary(corpus, order_col="row_id")
    got = {r["symbol"]: r for r in vocab.collect()}
    assert set(got) == {"S10004 S22a04", "S38800"}
    e = got["S10004 S22a04"]
    assert (e["canonical"], e["canonical_first2"], e["n_rows"], e["n_words"]) == ("this|that", "this|that", 2, 4)
    assert e["fsw"] == "M510x527S10004495x473S22a04490x512"
    assert got["S10004 S22a04"]["id"] == 0 and got["S38800"]["id"] == 1

    sents = spark.createDataFrame([
        (10, "a sentence", "M1x1S22a04490x512S10004495x473 M500x500S38800464x496 M500x500S2ff00482x483"),
    ], "row_id long, sentence string, fsw string")
    units = vc.lookup_signs(vc.explode_sequences(sents, "row_id"), vocab)
    dec = vc.regroup_sentences(units, "row_id").first()
    assert dec["word"] == "this|that # full stop|. # <unk>"
    assert dec["symbol"] == "S22a04 S10004 | S38800 | S2ff00"
    assert (dec["n_signs"], dec["n_unk"]) == (3, 1)


def test_unknown_profile_and_append(spark):
    units = spark.createDataFrame([
        (1, 0, "S1 S2", "<unk>"), (1, 1, "S1 S2", "<unk>"), (2, 0, "S3", "<unk>"), (2, 1, "S9", "w"),
    ], "sentence_id long, pos long, symbol string, word string")
    freq = {r["symbol"]: r["cnt"] for r in vc.unknown_frequency(units).collect()}
    assert freq == {"S1 S2": 2, "S3": 1}
    labelled = {(r["sentence_id"], r["pos"]): r["word"] for r in vc.label_unknowns(units, 1).collect()}
    assert labelled[(1, 0)] == "unk_1" and labelled[(2, 0)] == "<unk>" and labelled[(2, 1)] == "w"
    vocab = spark.createDataFrame([(0, "S9", "w", "w", "M500x500S9", 1, 1)],
                                  "id long, symbol string, canonical string, canonical_first2 string, fsw string, "
                                  "n_rows long, n_words long")
    ext = {r["id"]: r for r in vc.append_unknown_entries(vocab, units, 2).collect()}
    assert ext[1]["canonical"] == "unk_1" and ext[1]["symbol"] == "S1 S2"
    assert ext[1]["fsw"] == "M500x500S1500x500S2500x500"
    assert ext[2]["canonical"] == "unk_2"


def test_repetition_flag(spark):
    df = spark.createDataFrame([("a # a # a # a # a # a",), ("a # b",), ("",), ("x # <unk> ",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.repetition_flag(tx.split_units("t"))).collect()]
    assert got == [True, False, False, True, False]


def test_stored_entries_with_list_keys(spark):
    entries = spark.createDataFrame([
        (0, ["S10004 S22a04", "S38800"], ["go", "leave", "go"], ["F0", "F1", "F1"]),
        (1, ["S38800"], ["stop", "STOP", "halt"], ["F2"]),
    ], "id long, symbol array<string>, word array<string>, fsw array<string>")
    lex = {r["symbol"]: (r["canonical"], r["id"]) for r in vc.lexicon_from_entries(entries).collect()}
    assert lex["S10004 S22a04"] == ("go|leave", 0)
    # pooled lists of entries 0 and 1: go x2, stop x2 -> first seen wins the tie order
    assert lex["S38800"] == ("go|stop", 0)
    ent = {r["id"]: r for r in vc.entries_with_canonical(entries).collect()}
    assert ent[0]["canonical_first2"] == "go|leave" and ent[0]["fsw"] == "F1"
    assert ent[1]["canonical_first2"] == "stop|halt" and ent[1]["fsw"] == "F2"


def test_white_space_as_python_sees_it(spark):
    from signbridge.functions import text as tx
    texts = ["a\u00a0b", "a\u3000b c", " x\u2003", "\x1ca\x1f", "", "a\u200bb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.whitespace_tokens("t").alias("w"), tx.strip("t").alias("s"))
    assert all(r["w"] == r["t"].split() and r["s"] == r["t"].strip() for r in df.collect())


def test_counted_words_are_not_shuffled(spark, tmp_dir):
    """Every distinct word of a document was a row of the shuffle; ids may repeat or be null."""
    from signbridge.plans.queries import QUERIES
    rows = [(1, "b a B c"), (1, "c c\u00a0c"), (None, "x y"), (None, "Y"), (2, None), (3, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    out = QUERIES["canonical_top2_counted"](spark, tmp_dir)
    assert {tuple(r) for r in out.collect()} == {(1, "c|b"), (None, "y|x")}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
