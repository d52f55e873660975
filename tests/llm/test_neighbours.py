import numpy as np
import pytest
from pyspark.sql import functions as F

from signbridge.llm import neighbours
from signbridge.llm.common import table


def brute(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = unit @ unit[i]
        out[ids[i]] = [(ids[j], s[j]) for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    rows = table(spark, f"/root/testdata/sf{sf}", "embeddings")
    got = neighbours.search(rows, F.col("vec_id") % 50 == 0).collect()
    data = rows.orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    want = brute(ids, vectors, np.flatnonzero(ids % 50 == 0), 5)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(mine) == set(want)
    assert sum(len({v for v, _ in mine[q]} & {v for v, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    at = {v: i for i, v in enumerate(ids.tolist())}
    for q, found in mine.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(unit[at[q]] @ unit[at[v]] - s) < 1e-12 for v, s in found)


def test_all_rows_when_all_buckets_are_visited(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARE", 1.0)
    monkeypatch.setattr(neighbours, "BLOCK", 7)  # buckets in many blocks
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 6))
    vectors[40:80] = vectors[40]  # a third of all rows is one vector
    vectors[90] = 2 * vectors[40]
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, id int"), F.col("vec_id") % 10 == 0).collect()
    want = brute(np.arange(120), vectors, range(0, 120, 10), 5)
    for q, best in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([m[2] for m in mine], [s for _, s in best])
        if not 40 <= q < 80 and q != 90:
            assert [m[1] for m in mine][0] == best[0][0]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50 and r.vec_id != 90][:4] == [40, 41, 42, 43]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [None, 1.0]), (None, [1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (8, [0.0, 1.0]), (0, [1.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.search(docs, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 8)]
    assert neighbours.search(docs.where("false"), F.lit(True)).count() == 0
