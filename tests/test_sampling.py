"""Seeded splits/samples: exact sizes, disjointness, determinism, brute-force order."""

import hashlib

from signbridge.operators import indexing as ix
from signbridge.operators import sampling as sm


def _order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


def test_split_sizes_and_membership(spark):
    ids = list(range(1000))
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r["doc_id"]: r["split"] for r in sm.split_train_dev_test(df, "doc_id").collect()}
    order = _order(ids, 42)
    assert [got[i] for i in order[:25]] == ["test"] * 25
    assert [got[i] for i in order[25:50]] == ["dev"] * 25
    assert all(got[i] == "train" for i in order[50:])


def test_sample_is_first_n_in_hash_order(spark):
    ids = list(range(2301))
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    got = sorted(r["row_id"] for r in sm.sample_fraction(df, "row_id").collect())
    assert len(got) == 115
    assert got == sorted(_order(ids, 42)[:115])


def test_seed_samples_disjoint_per_seed_and_sized(spark):
    df = spark.createDataFrame([(i,) for i in range(400)], "row_id long")
    rows = sm.sample_fraction_seeds(df, "row_id", [1, 2, 3]).collect()
    by_seed = {}
    for r in rows:
        by_seed.setdefault(r["seed"], []).append(r["row_id"])
    assert {s: len(v) for s, v in by_seed.items()} == {1: 20, 2: 20, 3: 20}
    assert sorted(by_seed[2]) == sorted(_order(range(400), 2)[:20])


def test_rank_independent_of_partitions(spark):
    df = spark.createDataFrame([(i,) for i in range(300)], "row_id long")
    a = {r["row_id"]: r["pos"] for r in sm.seeded_shuffle(df.repartition(7), "row_id").collect()}
    b = {r["row_id"]: r["pos"] for r in sm.seeded_shuffle(df.coalesce(1), "row_id").collect()}
    assert a == b and sorted(a.values()) == list(range(300))


def test_dense_index_consecutive(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in [50, 3, 17, 9, 1000, -4]], "k long, v string")
    got = {r["k"]: r["idx"] for r in ix.dense_index(df.repartition(3), ["k"], "idx", 4).collect()}
    assert got == {-4: 0, 3: 1, 9: 2, 17: 3, 50: 4, 1000: 5}


def test_rows_without_id_and_odd_columns(spark):
    rows = [(i if i % 10 else None, f"text {i}", "a", 1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _part string, _total int, _h int")
    split = sm.split_train_dev_test(df, "doc_id").collect()
    assert sorted(r["text"] for r in split) == sorted(r[1] for r in rows)
    assert sorted(r["split"] for r in split).count("test") == 3 and sum(r["split"] == "dev" for r in split) == 2
    assert {(r["_part"], r["_total"], r["_h"]) for r in split} == {("a", 1, 2)}
    assert sm.sample_fraction(df, "doc_id", pct=100).count() == 100 and sm.sample_fraction(df, "doc_id", pct=7).count() == 7
    assert sorted(r["pos"] for r in sm.seeded_shuffle(df, "doc_id").collect()) == list(range(100))
    per_seed = sm.sample_fraction_seeds(df, "doc_id", [1, 2], pct=20).groupBy("seed").count().collect()
    assert {(r["seed"], r["count"]) for r in per_seed} == {(1, 20), (2, 20)}
    # rows without id are spread: they don't all stand together
    places = sorted(r["pos"] for r in sm.seeded_shuffle(df, "doc_id").where("doc_id is null").collect())
    assert places != list(range(places[0], places[0] + 10))
