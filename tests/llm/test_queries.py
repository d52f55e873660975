"""The registered queries on the smallest tables: contract columns, and every value by brute force or SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from signbridge.llm import bpe, html_text
from signbridge.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_quality": ["doc_id", "held_out", "expected_grade", "p_grade", "selected"],
    "op7_licences": ["doc_id", "n_paragraphs", "n_notices", "families"],
    "op8_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_html_text": ["page_id", "url", "text", "n_chars"],
    "op11_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op12_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op10_neighbours": ["query_id", "rank", "vec_id", "score"],
}


@pytest.fixture(scope="module")
def results(spark):
    held = {}

    def of(name):
        if name not in held:
            df = QUERIES[name](spark, SF)
            held[name] = (df.columns, df.collect())
        return held[name]

    return of


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall())


def test_names():
    assert sorted(COLUMNS) == sorted(n for n in QUERIES if n != "pipeline")


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(results, docs, name):
    columns, rows = results(name)
    assert columns[: len(COLUMNS[name])] == COLUMNS[name]
    if "doc_id" in columns:
        assert sorted(r.doc_id for r in rows) == list(docs)
    if "held_out" in columns:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("name", ORACLE)
def test_oracle(results, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    columns, rows = results(name)
    want = con.execute(f"""select {', '.join(f'"{c}"' for c in columns)} from ({ORACLE[name]})""").fetchall()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_token_store(results, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc_id, text in docs.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in results("op1_token_store")[1]) == want


def test_bpe(results, docs):
    ranks = bpe.codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(ids := library.encode_ordinary(t)), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for d, t in docs.items()]
    assert sorted(map(tuple, results("op3_bpe")[1])) == want


def test_scores(results):
    for name in ("op2_toxicity", "op5_language"):
        assert all(0 <= r.score <= 1 for r in results(name)[1])
    assert all(r.predicted == int(r.score >= 0.5) for r in results("op2_toxicity")[1])


def test_pages(results):
    pages = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    rows = results("op9_html_text")[1]
    assert {r.page_id: r.text for r in rows} == {i: html_text.main_text(h) for i, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_neighbours(results):
    ids = [r[0] for r in duckdb.sql(f"select vec_id from '{SF}/embeddings.parquet'").fetchall()]
    rows = results("op10_neighbours")[1]
    assert {r.query_id for r in rows} == {i for i in ids if i % 50 == 0}
    assert all(r.vec_id != r.query_id for r in rows) and len(rows) == 5 * len({r.query_id for r in rows})
