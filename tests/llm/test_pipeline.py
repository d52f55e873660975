"""The pipeline against a brute-force version, stage by stage, and whole."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from signbridge.llm import bpe, language, toxicity
from signbridge.llm.common import scratch_path, table

from test_decontamination import words
from test_near_duplicates import brute as near

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark):
    """The test tables with planted rows: copies, leaks, texts without letters, nulls."""
    path = scratch_path(spark, "pipeline")
    docs = table(spark, SF, "documents")
    some = [r for r in docs.orderBy("doc_id").collect() if r.n_chars > 600][:6]
    item = next(r.text for r in table(spark, SF, "benchmark").orderBy("item_id").collect() if len(words(r.text)) > 12)
    extra = [(9001, some[0].text), (9002, some[0].text.replace(" ", "  ")), (9003, some[1].text + " tail"), (9004, "1234 !!! 5678"),
             (9005, None), (9006, ""), (9007, some[2].text + "\n" + item), (9008, item.upper()), (9009, some[3].text), (9009, some[3].text), (None, "the of and with")]
    planted = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in extra], docs.schema)
    docs.unionByName(planted).coalesce(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{path}/{name}.parquet")
    return path


def brute(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [r for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")]
    kept = spark.createDataFrame(rows, docs.schema)
    assert {r.lang_pred for r in language.predict(kept, language.fit(docs)).collect()}.isdisjoint({"und"})
    model = toxicity.fit(kept, table(spark, sf_dir, "labels"))
    toxic = {(r.doc_id, r.text) for r in kept.withColumn("p", toxicity.scored(kept["text"], model)).where("p >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in rows if (r.doc_id, r.text) not in toxic]
    first = {d: c for d, _, c in near(rows, 5, 80)}
    rows = sorted({(d, t) for d, t in rows if d is not None and first[d] == d}) + [(d, t) for d, t in rows if d is None]
    grams = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        w = words(r.text)
        grams |= {tuple(w[i: i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    clean = []
    for d, t in rows:
        w = words(t)
        if not any(tuple(w[i: i + n]) in grams for n in sizes for i in range(len(w) - n + 1)):
            clean.append((d, t))
    ranks = bpe.codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for d, t in clean:
        ids = library.encode_ordinary(t)
        out.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    return sorted(out, key=str)


def test_against_brute_force(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == brute(spark, sf_dir)
    ids = {r.doc_id for r in got}
    assert ids.isdisjoint({9001, 9002, 9003, 9004, 9005, 9006, 9007, 9008, 9009})
    assert None in ids


def test_stages_keep_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == COLUMNS, name
        assert 0 < docs.count() <= before
        before = docs.count()


def test_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_without_languages(spark, sf_dir):
    """Nothing to learn a language from: only texts without a letter are rejected, and the pipeline returns its rows."""
    path = scratch_path(spark, "pipeline-unlabelled")
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).write.parquet(f"{path}/{name}.parquet")
    docs = table(spark, path, "documents")
    assert language.fit(docs) is None
    want = sorted((r.doc_id, r.text) for r in docs.where("doc_id is not null").collect() if re.search(r"[^\W\d_]", r.text or ""))
    kept = corpus_pipeline.identify_language(spark, docs, path)
    assert kept.columns == COLUMNS
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == want
    key = lambda df: sorted(((r.doc_id, r.ids_sha256) for r in df.collect()), key=str)
    assert key(corpus_pipeline.run(spark, path)) == key(corpus_pipeline.run(spark, sf_dir))
