"""Stream-static sign lookup over a file stream (by-product of the row-local design)."""

import os

from signbridge.operators import vocab as vc
from signbridge.streaming.lookup import start_lookup


def test_stream_lookup(spark, tmp_dir):
    corpus = spark.createDataFrame([(1, "this|that", "M510x527S10004495x473S22a04490x512")],
                                   "row_id long, word string, fsw string")
    vocab = vc.build_vocabulary(corpus, order_col="row_id")
    src = os.path.join(tmp_dir, "src")
    spark.createDataFrame([(1, 0, "M1x1S22a04490x512S10004495x473"), (1, 1, "M500x500S38800464x496")],
                          "sentence_id long, pos long, fsw string").write.parquet(src)
    q = start_lookup(spark, src, "sentence_id long, pos long, fsw string", vocab,
                     os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    got = {r["pos"]: r["word"] for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    assert got == {0: "this|that", 1: "<unk>"}
