"""WARC archives of web pages: written, normalised to one gzip member a record, indexed, read back.

Method: monolithic gzip normaliser. Tasks write their pages as WARC 1.1 records into archives that
are one gzip stream each, as crawlers and tools often leave them: nothing in such a file can
be reached without inflating all before it. The normaliser inflates every archive once, as a
stream, writes each record as a gzip member of its own and a sidecar index beside it, a line of tab-separated
values for each record: offset, length, type, page, record id, payload digest, target. From then on
an archive can be cut at any record: ``records`` reads spans of it in many tasks, ``fetch`` reads
single records.

Equal payloads of at least ``least`` bytes are stored once: the record of the least page id is the
response, the others revisit it (profile identical-payload-digest). Payloads are compared by their SHA-1.

Files are written below a folder that all executors share, by any scheme that Arrow knows, under a name
that no other attempt has; the table of archives names those of the tasks that Spark committed. A lost
or repeated task leaves at most a file that no table names.

Cases: null html is an empty payload; without url the target is ``urn:page:<id>``, control characters and spaces in a url
are percent-encoded. Pages without id are responses that nothing refers to. Of rows that share page
id and payload, the first by url is the response, the others revisit that page. An empty table gives no
archive. Records of any size pass the normaliser in pieces; an archive ends after ``ARCHIVE_BYTES``, or one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signbridge.llm.common import fits, give_back, stored

#: Bytes of records after which an archive ends; compressed bytes of a span that one task reads.
ARCHIVE_BYTES = 256 << 20
SPAN_BYTES = 16 << 20
LEVEL = 3
MAX_BROADCAST_BYTES = 32 << 20
#: Payloads that are more than this part of all repeated ones are at most as many.
HOT = 20_000
_PIECE = 1 << 20

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

ARCHIVES = "path string, records long, bytes long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# ---- which record is a response -----------------------------------------------------------

def repeated_payloads(rows: DataFrame) -> DataFrame:
    """(digest, first, copies, n): of each payload that several rows with an id have, the least id, how many
    rows have both, and the number of rows."""
    ids = rows.where("page_id is not null").groupBy("digest", "page_id").agg(F.count("*").alias("c"))
    groups = ids.groupBy("digest").agg(F.min(F.struct("page_id", "c")).alias("f"), F.sum("c").alias("n")).where("n > 1")
    return stored(groups.select("digest", F.col("f.page_id").alias("first"), F.col("f.c").alias("copies"), "n"), "repeated")


def _with_first(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with first and copies. Beyond the broadcast bound only the payloads with very many rows, of which
    there are at most ``HOT``, are broadcast; the others meet in a shuffle, in groups that are small against all."""
    known = repeated.select("digest", "first", "copies", "n")
    if fits(known, MAX_BROADCAST_BYTES, F.lit(128)):
        return rows.join(F.broadcast(known.drop("n")), "digest", "left")
    many = known.agg(F.sum("n")).first()[0] / HOT
    hot = rows.join(F.broadcast(known.where(F.col("n") > many).drop("n")), "digest", "left")
    cold = hot.where("first is null").drop("first", "copies").join(known.where(F.col("n") <= many).drop("n"), "digest", "left")
    return hot.where("first is not null").unionByName(cold)


def with_references(pages: DataFrame, least: int = 0) -> DataFrame:
    """Per page: page_id, url, digest, n_bytes, refers_to (null for a response) and payload (null for a revisit)."""
    payload = F.coalesce(pages["html"].cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    repeated = repeated_payloads(rows.where(F.col("n_bytes") >= least))
    own = ["page_id", "url", "digest", "n_bytes"]
    if repeated.isEmpty():
        return rows.select(*own, F.lit(None).cast("long").alias("refers_to"), "payload")
    found = _with_first(rows, repeated)
    later = F.coalesce((F.col("n_bytes") >= least) & (F.col("page_id") != F.col("first")), F.lit(False))
    twice = F.coalesce((F.col("n_bytes") >= least) & (F.col("page_id") == F.col("first")) & (F.col("copies") > 1), F.lit(False))
    once = found.where(~twice).select(*own, F.when(later, F.col("first")).alias("refers_to"), F.when(~later, F.col("payload")).alias("payload"))
    if repeated.where("copies > 1").isEmpty():
        return once
    # rows that share id and payload: counted by url, of the first url one is the response
    alike = found.where(twice).groupBy(*own).agg(F.count("*").alias("c"), F.first("payload").alias("payload"))
    alike = stored(alike, "alike")
    least_url = alike.groupBy("digest", "page_id").agg(F.min(F.struct(F.col("url").isNotNull().alias("has"), "url")).alias("u"))
    alike = alike.join(least_url, ["digest", "page_id"])
    alike = alike.withColumn("lead", F.col("url").eqNullSafe(F.col("u.url")))
    responses = alike.where("lead").select(*own, F.lit(None).cast("long").alias("refers_to"), "payload")
    rest = alike.withColumn("c", F.col("c") - F.col("lead").cast("int")).where("c > 0")
    rest = rest.select(*own, F.col("page_id").alias("refers_to"), F.explode(F.sequence(F.lit(1), F.col("c"))))
    rest = rest.select(*own, "refers_to", F.lit(None).cast("binary").alias("payload"))
    return once.unionByName(responses).unionByName(rest)


# ---- files ---------------------------------------------------------------------------------

def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, payload: bytes, unique: str) -> bytes:
    own = "" if page_id is None else str(page_id)
    kind = "response" if refers_to is None else "revisit"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{own}:{digest}:{unique}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {_escaped(url) if url else f'urn:page:{own}'}", f"WARC-Payload-Digest: sha1:{digest}"]
    if own:
        lines.append(f"Page-ID: {own}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"".join([VERSION, b"\r\n", "\r\n".join(lines).encode(), b"\r\n\r\n", http, payload, b"\r\n\r\n"])


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of ``with_references`` into archives of one gzip stream each; (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        out, done = None, []

        def close() -> None:
            out.write(packed.flush())
            out.close()
            done.append((path, count, size))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            payloads = batch.column(5)
            for i, row in enumerate(zip(*columns, strict=True)):
                if out is None:
                    name = uuid.uuid4().hex
                    path, count, size = f"{folder}/{name}.warc.gz", 0, 0
                    out, packed = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                record = _record(*row, payloads[i].as_py() or b"", f"{name}-{count}")
                out.write(packed.compress(record))
                count, size = count + 1, size + len(record)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                                         ["path", "records", "bytes"])

    return stored(rows.select("page_id", "url", "digest", "n_bytes", "refers_to", "payload").mapInArrow(run, ARCHIVES), "archives")


class Inflated:
    """The bytes of a gzip file, of one or many members, in pieces of bounded size."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.unpack, self.held, self.rest = source, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        while True:
            if self.unpack.eof:
                left = self.unpack.unused_data or self.source.read(_PIECE)
                if not left:
                    return False
                self.unpack, self.rest = zlib.decompressobj(31), left
            packed = self.rest or self.source.read(_PIECE)
            piece = self.unpack.decompress(packed, _PIECE)
            self.rest = self.unpack.unconsumed_tail
            if piece:
                self.held += piece
                return True
            if not packed and not self.unpack.eof:
                raise ValueError("the archive ends within a gzip member")

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with ``mark``; None at the end of the file."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            piece = self.take(min(n, len(self.held)))
            n -= len(piece)
            yield piece


def headers(block: bytes) -> dict[str, str]:
    """The fields of a record's head, names in lower case."""
    version, *lines = block.decode().strip().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _normalise(source: pa.NativeFile, out: pa.NativeFile, index: pa.NativeFile) -> tuple[int, int]:
    stream, offset, count = Inflated(source), 0, 0
    lines: list[str] = []
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = headers(head)
        packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        written = out.write(packed.compress(head.lstrip()))
        for piece in stream.pieces(int(fields["content-length"]) + 4):
            written += out.write(packed.compress(piece))
        length = written + out.write(packed.flush())
        lines.append("\t".join([str(offset), str(length), fields["warc-type"], fields.get("page-id", ""), fields["warc-record-id"],
                                fields.get("warc-payload-digest", ""), fields.get("warc-target-uri", "")]))
        offset, count = offset + length, count + 1
        if len(lines) >= 4096:
            index.write(("\n".join(lines) + "\n").encode())
            lines = []
    if lines:
        index.write(("\n".join(lines) + "\n").encode())
    return count, offset


def _one_each(archives: DataFrame) -> DataFrame:
    """Each archive in a task of its own; the table has one row for each file of ``ARCHIVE_BYTES``."""
    count = archives.count()
    numbered = archives.withColumn("_i", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    return numbered.repartitionById(count, F.col("_i")).drop("_i") if count else archives


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Inflate every archive once and rewrite it below ``folder``, a member for each record, with its index in
    ``<path>.idx``; (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                source_fs, source = _store(path)
                with (source_fs.open_input_stream(source, compression=None) as given,
                      fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=_PIECE) as out,
                      fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index):
                    count, size = _normalise(given, out, index)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count]), pa.array([size])], ["path", "records", "bytes"])
        give_back()

    return stored(_one_each(archives).mapInArrow(run, ARCHIVES), "normalised")


def archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Pages (page_id, url, html) as normalised archives below ``folder``; (path, records, bytes)."""
    return normalise(write(with_references(pages, least), f"{folder}/streams"), f"{folder}/members")


# ---- reading -------------------------------------------------------------------------------

INDEX = "path string, offset long, length long, record_type string, page_id long, record_id string, payload_digest string, target string"


def index(archives: DataFrame) -> DataFrame:
    """The sidecar indexes as a table, a row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for lines in _index_lines(path):
                    rows = [line.split("\t") for line in lines]
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([path] * len(rows)), pa.array(map(int, columns[0]), pa.int64()), pa.array(map(int, columns[1]), pa.int64()),
                        pa.array(columns[2]), pa.array([int(x) if x else None for x in columns[3]], pa.int64()), *map(pa.array, columns[4:])],
                        ["path", "offset", "length", "record_type", "page_id", "record_id", "payload_digest", "target"])

    return _one_each(archives).mapInArrow(run, INDEX)


def _index_lines(path: str, many: int = 4096) -> Iterator[list[str]]:
    fs, name = _store(f"{path}.idx")
    with fs.open_input_stream(name, compression=None) as source:
        rest = b""
        while piece := source.read(_PIECE):
            *lines, rest = (rest + piece).split(b"\n")
            for k in range(0, len(lines), many):
                yield [line.decode() for line in lines[k: k + many]]


def spans(archives: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(path, start, stop): pieces of the archives that begin and end at a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                starts, stops, start, stop = [], [], 0, 0
                for lines in _index_lines(path):
                    for offset, length in (map(int, line.split("\t", 2)[:2]) for line in lines):
                        if offset + length - start > span_bytes and offset > start:
                            starts.append(start)
                            stops.append(offset)
                            start = offset
                        stop = offset + length
                if stop > start:
                    starts.append(start)
                    stops.append(stop)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()),
                                                  pa.array(stops, pa.int64())], ["path", "start", "stop"])

    found = stored(_one_each(archives).mapInArrow(run, "path string, start long, stop long"), "spans")
    return found.repartition(max(1, found.count()), "path", "start")


def _read(member: bytes, with_payload: bool) -> tuple:
    """What a record says, and what its payload is: id, target, type, refers_to, bytes and digest of the payload, payload."""
    block = zlib.decompress(member, 31)
    end = block.index(b"\r\n\r\n") + 4
    fields = headers(block[:end])
    body = block[end: end + int(fields["content-length"])]
    cut = body.index(b"\r\n\r\n") + 4
    digest, payload = fields["warc-payload-digest"].removeprefix("sha1:"), body[cut:]
    page = int(fields["page-id"]) if "page-id" in fields else None
    if fields["warc-type"] == "revisit":  # the full payload's size is in its HTTP head
        size = int(re.search(rb"(?mi)^Content-Length: *(\d+)", body[:cut])[1])
        return page, fields["warc-target-uri"], "revisit", int(fields["refers-to-page-id"]), size, digest, None
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload has the digest {found}, not {digest}")
    return page, fields["warc-target-uri"], "response", None, len(payload), digest, payload if with_payload else None


_RECORDS = pa.schema([("page_id", pa.int64()), ("target", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
RECORDS = "page_id long, target string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _tables(members: Iterator[bytes], with_payload: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for member in members:
        held.append(_read(member, with_payload))
        size += (held[-1][4] if with_payload else 0) + 256
        if size > _PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def _members(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The gzip members between two offsets, by the index."""
    fs, name = _store(path)
    with fs.open_input_file(name) as source:
        for lines in _index_lines(path):
            for offset, length in (map(int, line.split("\t", 2)[:2]) for line in lines):
                if start <= offset < stop:
                    yield source.read_at(length, offset)


def records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records, read back and their digests compared with their payloads (an error if one differs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
                yield from _tables(_members(path, start, stop), with_payload)
        give_back()

    return spans(archives).mapInArrow(run, RECORDS)


def fetch(entries: DataFrame) -> DataFrame:
    """The records of some rows of ``index``, with their payloads, each read by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[bytes]:
            for batch in batches:
                for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                    fs, name = _store(path)
                    with fs.open_input_file(name) as source:
                        yield source.read_at(length, offset)
        yield from _tables(members(), True)

    return entries.select("path", "offset", "length").mapInArrow(run, RECORDS)
