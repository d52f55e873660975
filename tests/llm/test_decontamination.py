import random
import re

import pytest

from signbridge.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_words string, _row string, items string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i: i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for gram, who in windows.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i: i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= who
        out.append((doc_id, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


def frames(spark, docs, items):
    left = spark.createDataFrame([(a, b, "clash", "clash", "clash") for a, b in docs], SCHEMA)
    return left, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, width int")


@pytest.fixture(scope="module")
def case():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [(50, "É one, Two"), (51, None), (52, "--"), (53, "É one, Two")]
    docs = [(i, say(30) + " " + r.choice(items[:12])[1].upper() + "; " + say(20)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "É ONE--two!"), (103, "é one two"), (None, items[4][1]), (104, " ".join([items[5][1]] * 300)), (105, say(4)), (105, say(4))]
    return docs, items


def test_against_brute_force(spark, case):
    left, right = frames(spark, *case)
    out = decontamination.find_leaks(left, right).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out), key=str)
    assert got == brute(*case)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in out)


def test_shuffled_join_finds_the_same(spark, case, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_SET_BYTES", -1)
    out = decontamination.find_leaks(*frames(spark, *case)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out), key=str) == brute(*case)


def test_documents_and_spans_go(spark, case):
    left, right = frames(spark, *case)
    verdict = {(d, t): brute([(d, t)], case[1])[0][2] for d, t in case[0]}
    kept = decontamination.decontaminate(left, right)
    assert kept.columns == left.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((k for k in case[0] if not verdict[k]), key=str)
    cut = decontamination.decontaminate(left, right, remove="spans").collect()
    assert len(cut) == len(case[0])
    want = {}
    for d, t in case[0]:
        w, hits = words(t), set()
        for i, text in case[1]:
            g = words(text)
            for k in range(max(1, len(g) - 9) if g else 0):
                gram = g[k: k + 10]
                for p in range(len(w) - len(gram) + 1):
                    if w[p: p + len(gram)] == gram:
                        hits |= set(range(p, p + len(gram)))
        want.setdefault(d, []).append([x for i, x in enumerate(w) if i not in hits])
    for r in cut:
        assert words(r.text) in want[r.doc_id]
        assert r["_row"] == "clash"


def test_empty_tables(spark, case):
    left, right = frames(spark, *case)
    assert decontamination.find_leaks(left.where("false"), right).count() == 0
    out = decontamination.find_leaks(left, right.where("false"))
    assert out.count() == len(case[0]) and out.where("contaminated or n_items > 0").count() == 0
    assert decontamination.decontaminate(left, right.where("false")).count() == len(case[0])
