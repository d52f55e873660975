"""Sign parsing, keys and sign-level string functions (hand cases)."""

from pyspark.sql import functions as F

from signbridge.functions import fsw as fx


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def test_parse_plain_sign(spark):
    p = _one(spark, fx.parse_sign, "M518x529S14c20481x471S27106503x489")
    assert (p["box"], p["x"], p["y"]) == ("M", 518, 529)
    assert [(s["symbol"], s["x"], s["y"]) for s in p["symbols"]] == [("S14c20", 481, 471), ("S27106", 503, 489)]


def test_parse_prefix_without_coordinates_is_ignored(spark):
    p = _one(spark, fx.parse_sign, "AS33b00S19210M519x547S33b00482x483S19210504x515")
    assert p["box"] == "M"
    assert [s["symbol"] for s in p["symbols"]] == ["S33b00", "S19210"]


def test_missing_box_defaults_to_centre(spark):
    p = _one(spark, fx.parse_sign, "S38800464x496")
    assert (p["box"], p["x"], p["y"]) == ("M", 500, 500)
    assert len(p["symbols"]) == 1


def test_key_is_order_free(spark):
    a = _one(spark, fx.symbol_key, "M500x500S20300486x496S11f01461x491")
    b = _one(spark, fx.symbol_key, "B511x501S11f01461x491S20300486x496")
    assert a == b == "S11f01 S20300"


def test_clean_sign_flat_and_sorted(spark):
    seq = "M518x529S27106503x489S14c20481x471 B500x500S38800464x496"
    plain = _one(spark, lambda c: fx.clean_sign_seq(c), seq)
    srt = _one(spark, lambda c: fx.clean_sign_seq(c, sort=True), seq)
    assert plain["symbols"] == "M S27106 S14c20 B S38800"
    assert plain["xs"] == "518 503 481 500 464"
    assert srt["symbols"] == "M S14c20 S27106 B S38800"
    assert srt["xs"] == "518 481 503 500 464"
    assert srt["ys"] == "529 471 489 500 496"


def test_sorted_symbols_stable_on_equal_ids(spark):
    seq = "M500x500S10000490x490S10000480x480"
    srt = _one(spark, lambda c: fx.clean_sign_seq(c, sort=True), seq)
    assert srt["xs"] == "500 490 480"


def test_clean_symbol_sequence(spark):
    seq = "M518x529S27106503x489S14c20481x471 M500x500S38800464x496"
    assert _one(spark, lambda c: fx.clean_symbol_seq(c, glue="|"), seq) == "S27106 S14c20|S38800"
    assert _one(spark, lambda c: fx.clean_symbol_seq(c, glue="|", order=True), seq) == "S14c20 S27106|S38800"
    assert _one(spark, lambda c: fx.clean_symbol_seq(c, glue="|", add_box_symbol=True), seq) == \
        "M S27106 S14c20|M S38800"


def test_pseudo_fsw(spark):
    assert _one(spark, fx.symbol_to_pseudo_fsw, "S10004 S22a04") == "M500x500S10004500x500S22a04500x500"


def test_factor_tokens_roundtrip(spark):
    line = "M|500|500 S38800|464|496 M|518|529 S14c20|481|471"
    assert _one(spark, fx.factors_to_fsw, line) == "M500x500S38800464x496 M518x529S14c20481x471"
    assert _one(spark, fx.fsw_to_factors, "M500x500S38800464x496 M518x529S14c20481x471") == line
