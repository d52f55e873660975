"""Merkle manifests against a tree built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from signbridge.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i: i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, pos):
    out = []
    for level in levels[:-1]:
        out += level[pos ^ 1: (pos ^ 1) + 1]
        pos >>= 1
    return out


def brute(rows, tampered=lambda i: False):
    """id, part, leaf, subroot, root, proof, whether the tampered leaf still gives the root."""
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append(row)
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    first = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    trees = {p: tree([leaf(r) for r in sorted(parts[p], key=first)]) for p in order}
    top = tree([trees[p][-1][0] for p in order]) if order else []
    out = []
    for k, p in enumerate(order):
        for i, row in enumerate(sorted(parts[p], key=first)):
            proof = siblings(trees[p], i) + siblings(top, k)
            changed = tampered(row[0]) and row[3] is not None
            out.append((row[0], p, leaf(row), trees[p][-1][0], top[-1][0], "".join(proof), not changed))
    return sorted(out, key=str)


@pytest.mark.parametrize("step", [1, 3, 8])
def test_all_sizes(spark, step):
    rows = [(i, "s", f"part {n}", i, f"text é {i}") for n in (1, 2, 3, 4, 5, 8, 9, 17, 64, 65, 300) for i in range(n * 1000, n * 1000 + n)]
    docs = spark.createDataFrame(rows, COLUMNS)
    tampered = F.col("doc_id") % 7 == 0
    got = merkle.documents_manifest(docs, tampered, step).collect()
    assert sorted([(r.id, r.part, r.leaf, r.subroot, r.root, r.proof, r.verified) for r in got], key=str) == brute(rows, lambda i: i % 7 == 0)
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 1, ""), (7, "s", "", 2, "a"), (7, "s", "", 2, "a"), (7, "s", "", 3, "b"),
            (7, None, "=", 4, None), (14, "x", "é", None, "c"), (21, "x", "z", 5, "-"), (28, "x", "Z", 0, "x" * 200_000)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("part", F.lit(1)).withColumn("node", F.lit(2))
    got = merkle.documents_manifest(docs, F.col("doc_id") % 7 == 0).collect()
    # in the order of hashes among equal ids; a row without n_chars can't be told from its tampered self
    assert sorted([(r.id, r.part, r.leaf, r.subroot, r.root, r.proof, r.verified) for r in got], key=str) == brute(rows, lambda i: i is not None)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "a")], COLUMNS)
    row = merkle.documents_manifest(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof == "" and row.verified
    assert merkle.documents_manifest(docs.where("false")).count() == 0


def test_rows_that_are_all_alike(spark):
    docs = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                    F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    got = merkle.documents_manifest(docs, step=4).collect()
    assert len(got) == 1000 and all(r.verified for r in got) and sorted(r.proof for r in got) == sorted(r[5] for r in brute([(5, "s", "en", 1, "t")] * 1000))


def test_large_roots_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MAX_BROADCAST_BYTES", 0)
    rows = [(i, "s", str(i % 5), i, "x") for i in range(50)]
    got = merkle.documents_manifest(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted([(r.id, r.part, r.leaf, r.subroot, r.root, r.proof, r.verified) for r in got], key=str) == brute(rows)
