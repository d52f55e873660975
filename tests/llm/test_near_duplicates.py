import random
import re

import numpy as np
import pytest

from signbridge.llm import near_duplicates as nd
from signbridge.llm import common
from signbridge.llm.components import components

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text, width):
    w = [x for x in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i: i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    """(doc_id, n_shingles, component) of each row, over all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted(((d, len(s), top(d) if d is not None else None) for (d, _), s in zip(rows, sets)), key=str)


def corpus(seed, families, size, edits, words=60):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(words // 2, words))]
        for _ in range(size):
            now = list(base)
            for _ in range(r.choice(edits)):
                now[r.randrange(len(now))] = r.choice(vocabulary)
            rows.append((n * 7 % 1009, " ".join(now)))
            n += 1
    return rows


def run(spark, rows, width=4, percent=80):
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, n long, component_id int")
    out = nd.near_duplicates(docs, width, percent).collect()
    assert all(r.kept == (r.component_id is None or r.component_id == r.doc_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def test_word_hashes_follow_words():
    raw, at = np.frombuffer(b"The the  THE\tcatthe\x0bcat\xc3\x89", np.uint8), np.array([0, 16, 25])
    h, ends = nd.word_hashes(raw, at)
    assert ends.tolist() == [0, 4, 6]
    assert h[0] == h[1] == h[2] == h[4] and h[3] != h[5]
    assert len(set(h.tolist())) == 3


@pytest.mark.parametrize("sizes", [[], [np.array([], np.int64)], None])
def test_overlaps(sizes):
    r = random.Random(1)
    sets = sizes if sizes is not None else [np.unique([r.randrange(80) for _ in range(r.randint(0, 60))]).astype(np.int64) for _ in range(40)]
    got = nd.overlaps(sets)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]


@pytest.mark.parametrize("rows", [1 << 19, 0])
def test_families_near_the_threshold(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "GATHERED_ROWS", rows)  # small tables in one task, or all of them in many
    monkeypatch.setattr(nd, "BLOCK", 8)  # many blocks and large components
    rows = corpus(3, 10, 25, [0, 1, 2, 3, 4])
    assert run(spark, rows) == brute(rows, 4, 80)


def test_chains_and_shared_passages(spark):
    r = random.Random(8)
    vocabulary = [f"u{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows = [(i, " ".join([*passage, *(r.choice(vocabulary) for _ in range(r.choice([4, 25])))])) for i in range(60)]
    chain = [r.choice(vocabulary) for _ in range(80)]
    for i in range(30):  # each a step from the one before, the ends far apart
        chain = chain[2:] + [r.choice(vocabulary) for _ in range(2)]
        rows.append((1000 - i, " ".join(chain)))
    assert run(spark, rows) == brute(rows, 4, 80)
    assert run(spark, rows, 5) == brute(rows, 5, 80)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one two"), (5, "ONE  two"), (6, "two one"), (None, "one two"), (7, "a b c d"), (7, "a b c d"),
            (8, long), (9, long + " tail"), (10, "é É"), (11, "É é"), (12, "p q r s t"), (13, "zz " * 500), (14, "zz " * 700)]
    rows += [(13, "p q r s t")]  # an id with two texts links what each is like
    assert run(spark, rows) == brute(rows, 4, 80)


def test_many_copies(spark):
    rows = [(i, "same text for all of us here") for i in range(400)] + [(500 + i, f"alone {i} and with other words {i}") for i in range(20)]
    got = run(spark, rows)
    assert {c for d, _, c in got if d < 400} == {0} and all(d == c for d, _, c in got if d >= 500)


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (3, "other words of this text are not like it", "z"),
            (4, None, "n"), (3, "other words of this text are not like it", "a"), (None, "a b c d e f g h", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    out = nd.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(docs).count() == 0
    assert nd.keep_one(docs).count() == 0


@pytest.mark.parametrize("rows", [1 << 19, 0])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "GATHERED_ROWS", rows)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200), (None, 3), (5, None), (100, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
