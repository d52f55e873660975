"""Periodic runs against a plain search over all lags."""

import random

import numpy as np
import pytest

from signbridge.llm import periodic_runs
from signbridge.llm.periodic_runs import find, runs


def brute(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i = max(i, start + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def found(docs, least=12):
    owner, *rest = find(np.array([w for d in docs for w in d], np.int64), np.cumsum([len(d) for d in docs]), least)
    rows = list(zip(owner.tolist(), *(x.tolist() for x in rest), strict=True))
    return [[r[1:] for r in rows if r[0] == i] for i in range(len(docs))]


@pytest.mark.parametrize("least", [2, 5, 12, 30])
def test_all_lags(least):
    rng = random.Random(least)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(0, 120))]
            if words and rng.random() < 0.6:
                a = rng.randrange(len(words))
                p = 1 + rng.randint(0, (len(words) - a) // 2)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            docs.append(words)
        assert found(docs, least) == [brute(d, least) for d in docs]


def test_words_of_one_kind_and_pairs_beyond_a_range_of_lags(monkeypatch):
    assert found([[7] * 200_000]) == [[(0, 200_000, 1)]]
    fib = [0, 1]
    while len(fib) < 3000:
        fib = fib + fib[: len(fib) * 5 // 8] if len(fib) > 2 else [0, 1, 0]
    whole = found([fib[:3000], [1, 2] * 700])
    monkeypatch.setattr(periodic_runs, "MAX_PAIRS", 100)
    assert found([fib[:3000], [1, 2] * 700]) == whole == [brute(fib[:3000]), brute([1, 2] * 700)]


def test_least_lengths():
    assert found([[1, 2] * 5 + [1]]) == [[]] and found([[1, 2] * 6]) == [[(0, 12, 2)]]
    eight = list(range(8))
    assert found([eight + eight[:7]]) == [[]] and found([[9, *eight, *eight, 5]]) == [[(1, 16, 8)]]
    # a document that ends as the next begins makes no run over the border
    assert found([[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]]) == [[], []]


def test_rows(spark):
    text = "x " + "a b c " * 5 + "y"
    docs = spark.createDataFrame([(1, text, 0, "u"), (1, text, 0, "u"), (None, " \t\n", 1, "v"), (3, None, 2, "w"), (4, "", 3, ""), (5, "é\x0bé é " * 9, 4, "")],
                                 "doc_id long, text string, runs int, collapsed string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs(docs).collect()), key=str)
    once = (1, 17, [(1, 15, 3)], "x a b c y")
    assert got == sorted([once, once, (None, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 18, [(0, 18, 2)], "é é é")], key=str)
    assert runs(docs.where("false")).count() == 0


def test_overlapping_runs_and_the_longest(spark):
    words = ["a", "b"] * 6 + ["a", "c"] * 6 + ["z"] * 3
    docs = spark.createDataFrame([(0, " ".join(words))], "id long, body string")
    row = runs(docs, doc_id="id", text="body").withColumn("best", periodic_runs.longest()).withColumn("lines", periodic_runs.run_lines()).first()
    want = brute(words)
    assert [tuple(r) for r in row.runs] == want and row.lines == "".join(f"{s},{n},{q}\n" for s, n, q in want)
    s, n, q = min(want, key=lambda r: (-r[1], r[0], r[2]))
    assert tuple(row.best) == (s, n, q, 1000 * n // q)
    gone = {i for s, n, q in want for i in range(s + q, s + n)}
    assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_planted(spark):
    import zlib
    texts = {i: " ".join(f"w{j}" for j in range(i % 50)) for i in range(200)}
    docs = spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in periodic_runs.with_planted_periods(docs).collect()}
    assert got.pop(None) == "a b"
    for i, text in texts.items():
        h, words = zlib.crc32(str(i).encode()), text.split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w if j < a else words[a + (j - a) % p] for j, w in enumerate(words))
        assert got[i] == text
