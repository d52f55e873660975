"""Sub-word merges: determinism, round trip, stored-artefact decode."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from signbridge.operators import subword as sw

# Lines of our own in the stored form: pieces apart, word starts marked.
STORED_PIECES = [
    ('▁The ▁b oa t ▁left , ▁and ▁" no ▁one " ▁s aw ▁it .', 'The boat left, and "no one" saw it.'),
    ("▁Part ▁3: ▁rain ing ▁a gain , ▁with ▁w ind .", "Part 3: raining again, with wind."),
]


def test_decode_stored_pieces(spark):
    df = spark.createDataFrame(STORED_PIECES, "p string, t string")
    assert all(r[0] == r[1] for r in df.select(sw.decode_pieces("p"), "t").collect())


def test_merge_pass_runs_left_to_right(spark):
    seg = "\u0001" + "\u0001".join("▁aaaaa") + "\u0001"
    df = spark.createDataFrame([(seg,)], "seg string")
    out = df.select(sw._merge_expr(F.col("seg"), [("a", "a")])).first()[0]
    assert [s for s in out.split("\u0001") if s] == ["▁", "aa", "aa", "a"]


def test_learn_encode_roundtrip(spark):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate([
        "low lower lowest", "newer newest wider", "low low low new new", "the theatre other"])],
        "doc_id long, text string")
    merges = sw.learn_merges(lines, vocab_size=40)
    ranks = [r["rank"] for r in merges.orderBy("rank").collect()]
    assert ranks == list(range(len(ranks))) and len(ranks) > 0
    again = sw.learn_merges(lines, vocab_size=40).orderBy("rank").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in merges.orderBy("rank").collect()]
    enc = sw.encode_lines(lines, merges).select("text", sw.decode_pieces("pieces").alias("back")).collect()
    assert all(" ".join(r["text"].split()) == r["back"] for r in enc)


def test_pick_rules():
    cands = [{"left": "a", "right": "b", "cnt": 10}, {"left": "a", "right": "c", "cnt": 9}, {"left": "b", "right": "c", "cnt": 9},
             {"left": "x", "right": "y", "cnt": 1}]
    assert sw._pick(cands, 10) == [("a", "b", 10), ("a", "c", 9)]
    assert sw._pick(cands, 1) == [("a", "b", 10)]


def greedy(texts, budget):
    """The rule in plain Python: all pairs counted again for every merge."""
    words = Counter(w for t in texts for w in t.split())
    parts = {w: list(sw.WORD_BOUNDARY + w) for w in words}
    out = []
    while len(out) < budget:
        counts = Counter()
        for w, n in words.items():
            for pair in zip(parts[w], parts[w][1:]):
                counts[pair] += n
        if not counts:
            break
        pair, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        out.append((len(out), *pair, "".join(pair), n))
        parts = {w: sw._merged(p, pair) for w, p in parts.items()}
    return out


@pytest.mark.parametrize(("task_bytes", "per_round"), [(1 << 20, 64), (0, 64), (0, 3)])
def test_same_merges_as_the_greedy_learner(spark, task_bytes, per_round):
    rng = random.Random(4)
    stems = ["the", "there", "then", "low", "lower", "aaaa", "aaab", "abab", "banana", "ananas", "aaaaaaa", "newest", "wide", "ée$", "x.y"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "", "s", "er", "ing"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    lines = spark.createDataFrame([(t,) for t in texts], "text string")
    alphabet = len({sw.WORD_BOUNDARY, *"".join(texts)} - {" "})
    merges = sw.learn_merges(lines, sw.SPECIAL_PIECES + alphabet + 60, merges_per_round=per_round, task_bytes=task_bytes)
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == greedy(texts, 60)


def test_words_of_the_input_keep_their_columns(spark):
    lines = spark.createDataFrame([("low low", 7, "k", 1.0)], "text string, _line int, _e string, pos double")
    out = sw.encode_lines(lines, sw.learn_merges(lines, 8)).collect()
    assert [(r["_line"], r["_e"], r["pos"]) for r in out] == [(7, "k", 1.0)]


def test_encode_against_plain_python(spark):
    lines = spark.createDataFrame([(0, "low lower lowest new"), (1, None), (2, ""), (3, "new\u00a0wide low")], "doc_id long, text string")
    merges = sw.learn_merges(lines, vocab_size=30)
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}

    def plain(word):
        parts = list(sw.WORD_BOUNDARY + word)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
            if not found:
                return parts
            i = min(found)[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]

    for r in sw.encode_lines(lines, merges).collect():
        want = None if r["text"] is None else " ".join(x for w in r["text"].split() for x in plain(w))
        assert r["pieces"] == want


def test_alphabet_must_fit(spark):
    lines = spark.createDataFrame([("abcdefghij",)], "text string")
    with pytest.raises(ValueError, match="doesn't hold"):
        sw.learn_merges(lines, vocab_size=8)


def test_few_rounds_and_encoding_without_shuffle(spark, monkeypatch):
    """A round ended at the first pair that touches a better one, and every word of every line was shuffled."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("the there then low lower banana ananas newest wide".split()) for _ in range(8)) for _ in range(40)]
    lines = spark.createDataFrame([(t,) for t in texts], "text string")
    rounds, changes = [], sw._changes
    monkeypatch.setattr(sw, "_changes", lambda *a: (rounds.append(a), changes(*a))[1])
    alphabet = len({sw.WORD_BOUNDARY, *"".join(texts)} - {" "})
    merges = sw.learn_merges(lines, sw.SPECIAL_PIECES + alphabet + 20, task_bytes=0)
    assert merges.count() == 20 and len(rounds) <= 3
    assert "Exchange" not in sw.encode_lines(lines, merges)._jdf.queryExecution().executedPlan().toString()
