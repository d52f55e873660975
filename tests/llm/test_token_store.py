import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signbridge.llm import perfect_hash, token_store
from signbridge.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)  # as it is: an added token in a text has its own id


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(rng.integers(0, 1 << 62, n)).astype(np.uint64)
        levels = perfect_hash.build(keys)
        assert sorted(perfect_hash.places(levels, keys).tolist()) == list(range(len(keys)))
        marks = np.zeros(len(keys), np.uint32)
        marks[perfect_hash.places(levels, keys)] = perfect_hash.fingerprints(keys)
        others = rng.integers(1 << 62, 1 << 63, 1000).astype(np.uint64)
        place = perfect_hash.places(levels, others)
        assert not (marks[place[place >= 0]] == perfect_hash.fingerprints(others)[place >= 0]).any()


def test_encoder_equals_the_library(library):
    r = random.Random(5)
    signs = "ab  theing\n\t.,!'s 0129éñ漢字😀\x85　​\x1c"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["", "a", "a b", "one two, three.\nFour five!! 12 ab12", "it's\n\nso", "end\n", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b <|endoftext", " \n", "b" * 5000]
    coder = token_store.Encoder(open(PATH).read())
    want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want
    assert coder.encode(texts[::-1]) == want[::-1]  # with what it remembers


def brute(library, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digests_of_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "CHUNK_IDS", 50)
    monkeypatch.setattr(token_store, "BUCKET_KEYS", 3)
    rows = [(7, "seven"), (None, "nobody"), (-3, None), (5, ""), (9, "nine nine " * 500), (1 << 40, "far"), *((i, f"text {i}") for i in range(20, 60))]
    docs = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, start int, key string")
    path = scratch_path(spark, "store-test")
    out = [tuple(r) for r in token_store.digests(docs, PATH, path).collect()]
    assert sorted(out, key=lambda r: r[1]) == brute(library, rows)
    asked = spark.createDataFrame([(7,), (8,), (None,), (1 << 40,), (1 << 41,), (7,)], "doc_id long")
    found = {r.doc_id: (r.start, r.length) for r in token_store.lookup(asked, path).collect()}
    assert found == {r[0]: (r[1], r[2]) for r in out if r[0] in (7, None, 1 << 40)}


def test_rows_that_share_an_id(spark, library):
    rows = [(1, "a"), (2, "same"), (2, "same"), (2, "other text"), (3, "c")]
    out = token_store.digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH).orderBy("start").collect()
    assert [r.doc_id for r in out] == [1, 2, 2, 2, 3]
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    assert sorted(r.ids_crc32 for r in out) == sorted(x[3] for x in brute(library, rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.digests(docs, PATH).count() == 0
