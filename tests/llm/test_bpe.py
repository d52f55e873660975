import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from signbridge.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def coder():
    return bpe.codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def random_texts(seed, n):
    r = random.Random(seed)
    signs = "ab  theing\n\t.,!'s 0129éñ漢字😀\x85　​\x1c"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return texts + ["".join(chr(r.randrange(1, 0x2FFF)) for _ in range(40)) for _ in range(n)]


def test_same_ids_as_the_library(coder, library):
    texts = random_texts(1, 800) + ["", " ", "\n\n  x", "a" * 5000, "thequick" * 300, "abcde" * 200, "漢" * 700, "!" * 2000, "<|endoftext|>"]
    ids, ends = coder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[ends[i]: ends[i + 1]].tolist() == library.encode_ordinary(text)
    data, at = coder.decode(ids, ends)
    assert [bytes(data[at[i]: at[i + 1]]) for i in range(len(texts))] == [t.encode() for t in texts]


def test_matrix_and_heap_agree(coder):
    r = random.Random(2)
    pieces = ["".join(r.choice("aeiontrshdl") for _ in range(r.randint(2, 250))).encode() for _ in range(300)]
    pieces = [p for p in pieces if p not in coder.ranks]
    assert [tuple(np.frombuffer(x, np.int32)) for x in coder.encode_pieces(pieces)] == [coder._by_heap(p) for p in pieces]


def test_memo_bound_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    small = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in random_texts(3, 40):
        assert small.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_rows(spark, library):
    rows = [Row(doc_id=1, text="hello wörld", token_ids="clash", n_tokens=-1), Row(doc_id=None, text="x y", token_ids=None, n_tokens=0),
            Row(doc_id=2, text=None, token_ids=None, n_tokens=0), Row(doc_id=3, text="", token_ids=None, n_tokens=0),
            Row(doc_id=1, text="hello wörld", token_ids="clash", n_tokens=-1), Row(doc_id=4, text="long " * 40000, token_ids=None, n_tokens=0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens int")
    out = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((r.doc_id or 0, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in rows)
    assert sorted((r.doc_id or 0, r.token_ids, bytes(r.decoded)) for r in out) == want
    assert bpe.round_trip(docs.where("false"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
