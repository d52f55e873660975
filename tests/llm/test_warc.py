"""WARC archives: round trips, an independent reading of the files, revisits, hot payloads."""

import base64
import gzip
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from signbridge.llm import warc

COLUMNS = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every row; of rows alike in id and payload one is the response."""
    first, out, seen = {}, [], set()
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(page, first.get(html or "", page))
    for page, _, html in rows:
        lead = first.get(html or "")
        small = page is None or len((html or "").encode()) < least
        response = small or (page == lead and (page, html or "") not in seen)
        seen.add((page, html or ""))
        out.append((page, len((html or "").encode()), digest(html), "response" if response else "revisit", None if response else lead))
    return sorted(out, key=str)


def read(archives, **options):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(archives, **options).collect()], key=str)


ROWS = [(3, "http://a/ b\r\nX: y", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (5, "http://c", ""), (None, "http://d", ""), (None, "http://d", ""),
        (9, "u2", "same"), (9, "u1", "same"), (9, "u1", "same"), (9, None, "same"), (12, "u", "same"), (7, "z", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 3),
        (8, "big", "0123456789" * 300_000), (9, "other", "another text of the same page")]


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_round_trip(spark, tmp_dir, monkeypatch, least, bound):
    monkeypatch.setattr(warc, "MAX_BROADCAST_BYTES", bound)
    monkeypatch.setattr(warc, "HOT", 2)
    pages = spark.createDataFrame(ROWS, COLUMNS).withColumn("payload", F.lit(1)).withColumn("digest", F.lit("x"))
    archives = warc.archive(pages, f"{tmp_dir}/w", least)
    assert read(archives) == brute(ROWS, least)
    payloads = {(r.page_id, r.payload.decode()) for r in warc.records(archives, with_payload=True).where("record_type = 'response'").collect()}
    assert payloads == {(p, h or "") for p, _, h in ROWS if len((h or "").encode()) < least or (p, h) not in {(3, "<p>é</p>"), (5, ""), (12, "same")}}


def test_files(spark, tmp_dir):
    """Each archive of the first step is one gzip stream; each record of the second is a member that its index finds."""
    pages = spark.createDataFrame(ROWS, COLUMNS).coalesce(2)
    streams = warc.write(warc.with_references(pages), f"{tmp_dir}/streams", archive_bytes=2000)
    files = [r.path for r in streams.collect()]
    assert len(files) > 2 and streams.agg(F.sum("records")).first()[0] == len(ROWS)
    for path in files:
        unpack = zlib.decompressobj(31)
        with open(path, "rb") as f:
            unpack.decompress(f.read())
        assert unpack.eof and not unpack.unused_data
    archives = warc.normalise(streams, f"{tmp_dir}/members")
    whole = lambda rows: sorted(record for r in rows for record in re.findall(rb"(?s)WARC/1\.1\r\nWARC-Type: re.*?(?=WARC/1\.1\r\nWARC-Type: re|\Z)", gzip.open(r.path).read()))
    assert whole(archives.collect()) == whole(streams.collect())  # byte for byte
    entries = warc.index(archives).collect()
    assert len(entries) == len(ROWS)
    for e in entries:
        with open(e.path, "rb") as f:
            f.seek(e.offset)
            unpack = zlib.decompressobj(31)
            record = unpack.decompress(f.read(e.length))
        assert unpack.eof and not unpack.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert f"WARC-Record-ID: {e.record_id}\r\n".encode() in record
    got = warc.fetch(warc.index(archives).where("page_id = 8")).collect()
    assert [(r.page_id, r.payload.decode()) for r in got] == [(8, "0123456789" * 300_000)]


def test_spans(spark, tmp_dir):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html"))
    archives = warc.archive(pages.coalesce(1), f"{tmp_dir}/w")
    cut = warc.spans(archives, 2000).collect()
    assert len(cut) > 5 and sorted((r.start, r.stop) for r in cut)[0][0] == 0
    assert read(archives) == brute([(i, "u", str(i) * 200) for i in range(500)])


def test_hot_payload(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST_BYTES", 0)
    rows = [(i, f"u{i}", "hot" if i % 3 else f"cold {i // 6}") for i in range(600)]
    assert read(warc.archive(spark.createDataFrame(rows, COLUMNS), f"{tmp_dir}/w")) == brute(rows)


def test_empty_and_broken(spark, tmp_dir):
    pages = spark.createDataFrame(ROWS[:2], COLUMNS)
    assert read(warc.archive(pages.where("false"), f"{tmp_dir}/e")) == []
    streams = warc.write(warc.with_references(pages.coalesce(1)), f"{tmp_dir}/s")
    path = streams.first().path
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends within"):
        warc.normalise(streams, f"{tmp_dir}/n")


def test_files_of_many_members(tmp_path):
    """The normaliser also takes archives that have members already."""
    import pyarrow as pa
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    out, index = pa.BufferOutputStream(), pa.BufferOutputStream()
    assert warc._normalise(pa.BufferReader(gzip.compress(one) + gzip.compress(one * 2)), out, index)[0] == 3
    assert gzip.decompress(out.getvalue().to_pybytes()) == one * 3
