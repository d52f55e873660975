"""Entries in chunks, the lexicon in buckets."""

import uuid

import pytest
from pyspark.sql import functions as F

from signbridge.operators import vocab as vc
from signbridge.sinks import writers as wr


@pytest.fixture(scope="module")
def corpus(spark):
    """Half of all rows have one sign; a few rows repeat, one has no word and one no sign."""
    rows = [(i, f"W{i % 40}|w{i % 7}" if i % 3 else f"w{i % 7}", "M500x500S38800464x496" if i % 2 else f"M518x529S1{i % 9:02x}00481x471S27106503x489")
            for i in range(600)]
    rows += [(600 + i, *rows[i][1:]) for i in range(5)] + [(700, None, "M500x500S38700463x496"), (701, "lost", None)]
    return spark.createDataFrame(rows, "p_partkey long, word string, fsw string").repartition(5)


def _plain(corpus):
    """symbol -> (words, signs) in corpus order, distinct (word, sign) rows."""
    seen, out = {}, {}
    for r in sorted(corpus.where("word is not null and fsw is not null").collect()):
        seen.setdefault((r["word"], r["fsw"]), r["p_partkey"])
    keys = {r["fsw"]: r["k"] for r in corpus.select("fsw", vc.fx.symbol_key(F.col("fsw")).alias("k")).distinct().collect()}
    for (word, sign), _ in sorted(seen.items(), key=lambda x: x[1]):
        words, signs = out.setdefault(keys[sign], ([], []))
        words += word.split("|")
        signs.append(sign)
    return out


@pytest.mark.parametrize("size", [1, 7, 256, 10_000])
def test_chunks_hold_the_lists(corpus, size):
    chunks = vc.entry_chunks(corpus, chunk_rows=size).collect()
    plain = _plain(corpus)
    ids = {symbol: i for i, symbol in enumerate(sorted(plain))}
    found = {}
    for c in sorted(chunks, key=lambda c: (c["symbol"], c["chunk"])):
        words, signs = found.setdefault(c["symbol"], ([], []))
        assert 0 < len(c["fsw"]) <= size and c["first"] == len(signs) and c["id"] == ids[c["symbol"]]
        words += c["word"]
        signs += c["fsw"]
    assert found == plain
    for symbol in plain:
        assert [c["chunk"] for c in sorted(chunks, key=lambda c: c["chunk"]) if c["symbol"] == symbol] == \
            list(range(sum(c["symbol"] == symbol for c in chunks)))


def test_readers_of_chunks(spark, corpus, tmp_dir):
    wr.write_table(vc.entry_chunks(corpus, chunk_rows=10), f"{tmp_dir}/chunks")
    chunks = spark.read.parquet(f"{tmp_dir}/chunks")
    assert sorted(vc.vocabulary_of_chunks(chunks).collect()) == sorted(vc.build_vocabulary(corpus).collect())
    lists = vc.entry_lists(corpus)
    assert {r["symbol"]: (r["word"], r["fsw"]) for r in lists.collect()} == _plain(corpus)
    assert sorted(vc.lexicon_from_entries(chunks).collect()) == sorted(vc.lexicon_from_entries(lists).collect())
    wr.write_entries(chunks, f"{tmp_dir}/json")
    back = spark.read.schema("id long, symbol string, word array<string>, fsw array<string>").json(f"{tmp_dir}/json")
    assert sorted(back.collect()) == sorted(lists.collect())


def test_chunks_of_nothing(spark, corpus):
    none = vc.entry_chunks(corpus.limit(0))
    assert none.count() == 0 and vc.lists_of_chunks(none).count() == 0 and vc.vocabulary_of_chunks(none).count() == 0


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_lookup(spark, corpus, tmp_dir):
    vocab = vc.build_vocabulary(corpus.where("p_partkey % 5 > 0"))
    signs = corpus.select(F.col("p_partkey").alias("sentence_id"), F.lit(0).cast("bigint").alias("pos"), "fsw")
    name = uuid.uuid4().hex
    vc.write_lexicon(vocab, f"lexicon_{name}", 6, f"{tmp_dir}/lexicon")
    vc.write_keyed_signs(signs, f"signs_{name}", 6, f"{tmp_dir}/signs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = vc.lookup_signs_bucketed(signs, f"lexicon_{name}")
        none = vc.lookup_signs_bucketed(spark.table(f"signs_{name}"), f"lexicon_{name}")
        # the signs are shuffled, the lexicon is not; bucketed signs are not either
        assert (_exchanges(one), _exchanges(none)) == (1, 0)
        expected = sorted(map(str, vc.lookup_signs(signs, vocab, broadcast_bytes=0).select(*one.columns).collect()))
        assert sorted(map(str, one.collect())) == expected
        assert sorted(map(str, none.select(*one.columns).collect())) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table lexicon_{name}")
        spark.sql(f"drop table signs_{name}")
