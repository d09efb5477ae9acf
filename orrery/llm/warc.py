"""WARC archives packaged in ZIP files, written and read in the shared folder.

A package holds `archive/data.warc.gz`, in which every record is a gzip member of its own, and `indexes/index.cdxj` with
each record's place, both stored, not deflated. The reader finds members through the ZIP's central directory, in its
ZIP64 form where needed, and reads index and records by byte ranges; nothing is unpacked.

Every task writes its own packages under names that its partition determines, beside the target and moved into place, so
that a repeated task replaces a file by an equal one.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Equal payloads of at least so many bytes are written once.
LEAST_REVISIT = 100
#: Bytes of a package after which a task begins another.
PACKAGE_BYTES = 256 << 20
#: Bytes and records of one range read.
CHUNK_BYTES, CHUNK_RECORDS = 4 << 20, 2_000
#: Rows up to which the table of repeated payloads is broadcast: at most about 20 MB.
BROADCAST_ROWS = 100_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"


# --- ZIP ---------------------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored: int
    header: int


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """The sizes and offsets that a ZIP64 field gives in place of those at their 32-bit limit."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, k = extra[at + 4 : at + 4 + n], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    (values[i],) = struct.unpack_from("<Q", field, k)
                    k += 8
        at += 4 + n
    return values


def members(read, size: int) -> list[Member]:
    """The members that a ZIP's central directory lists. ``read(offset, n)`` gives bytes of the file of ``size`` bytes."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    # The archive's comment may hold the marker, too: the true one has a comment that reaches to the end of the file.
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, begin = struct.unpack_from("<10xHII", tail, end)
    locator = tail[end - 20 : end]
    if locator[:4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<8xQ", locator)
        record = read(at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        count, length, begin = struct.unpack_from("<32xQQQ", record)
    directory, at, out = read(begin, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, stored, whole, n, m, c, header = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + n]
        whole, stored, header = _zip64(directory[at + 46 + n : at + 46 + n + m], [whole, stored, header])
        out.append(Member(name.decode("utf-8", "replace"), method, whole, stored, header))
        at += 46 + n + m + c
    return out


def data_offset(read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is deflated; ranges of it can't be read")
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    n, m = struct.unpack_from("<26xHH", head)
    return member.header + 30 + n + m


class _Stream:
    """What zipfile needs of an output that can't seek."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.n += len(data)
        return len(data)

    def flush(self) -> None:
        pass


# --- records -----------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A gzipped WARC record: response with the payload, or revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def parse(member: bytes) -> Record:
    """A record from its gzip member. A response's size and digest are those of its payload; a damaged one is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    declared = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    kind = fields["WARC-Type"]
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if found != digest or len(payload) != declared:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return Record(number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")), declared, digest, payload if kind == "response" else None)


# --- writing -----------------------------------------------------------------------------------


def plan(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload digest and what a record refers to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = base.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeated = common.cut(repeated)
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = base.join(repeated, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` as packages below ``folder``; a row for each: path, records, bytes. Rows are as ``archive`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, done = TaskContext.get().partitionId(), 0, []
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        row = next(rows, None)
        while row is not None:
            path = f"{folder}/part-{part:06d}-{number:04d}.wacz"
            lines, at, count = [], 0, 0
            with common.AtomicFile(path) as out, zipfile.ZipFile(stream := _Stream(out), "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                    while row is not None and at < PACKAGE_BYTES:
                        page_id, url, html, digest, refers_to = row
                        made = record(page_id, url, html.encode(), digest, refers_to)
                        data.write(made)
                        place = {"offset": at, "length": len(made), "digest": f"sha256:{digest}", "record": page_id}
                        lines.append(f"{_clean(url or '-')} {re.sub('[^0-9]', '', DATE)} {json.dumps(place)}")
                        at, count = at + len(made), count + 1
                        row = next(rows, None)
                with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                    for line in sorted(lines):
                        index.write(line.encode() + b"\n")
                package.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))
            done.append((path, count, stream.n))
            number += 1
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    common.bounded_batches(common.session(pages))
    return common.cut(plan(pages).mapInArrow(run, "path string, records long, bytes long"))


# --- reading -----------------------------------------------------------------------------------


def _reader(path: str):
    fs, plain = common.filesystem(path)
    handle = fs.open_input_file(plain)
    return handle, lambda at, n: handle.read_at(n, at)


def places(packages: DataFrame) -> DataFrame:
    """(path, begin, lengths) of ranges of whole records, from the packages' directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                handle, read = _reader(path)
                with handle:
                    found = {m.name: m for m in members(read, handle.size())}
                    base = data_offset(read, found[DATA])
                    index = found[INDEX]
                    lines = bytes(read(data_offset(read, index), index.size)).decode().splitlines()
                where = sorted((p["offset"], p["length"]) for p in (json.loads(line.split(" ", 2)[2]) for line in lines))
                chunks: list[tuple[int, list[int]]] = []
                total = 0
                for at, n in where:
                    if not chunks or total + n > CHUNK_BYTES or len(chunks[-1][1]) >= CHUNK_RECORDS:
                        chunks.append((base + at, []))
                        total = 0
                    chunks[-1][1].append(n)
                    total += n
                if chunks:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(chunks)), pa.array([c[0] for c in chunks], pa.int64()), pa.array([c[1] for c in chunks], pa.list_(pa.int64()))], names=["path", "begin", "lengths"])

    return packages.select("path").mapInArrow(run, "path string, begin long, lengths array<long>")


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read(packages: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the packages (path), with their payload (null for revisits) if asked for."""
    spark: SparkSession = common.session(packages)
    common.bounded_batches(spark)
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payload
    names = list(Record._fields[: len(types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, lengths in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                handle, read_at = _reader(path)
                with handle:
                    data = bytes(read_at(begin, sum(lengths)))
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse(data[at : at + n])[: len(types)])
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    chunks = places(packages)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, "path", "begin").mapInArrow(run, READ + ", payload binary" * payload)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html; other columns are ignored) and read the records back.

    Null html is an empty payload. Rows of equal payloads of LEAST_REVISIT bytes or more revisit the row with the
    smallest page_id; rows that repeat this page_id are responses. A null page_id or url is written as none. An empty
    table gives no packages and no rows.
    """
    spark = common.session(pages)
    packages = write(pages, folder or common.new_folder(spark, "warc"))
    return read(packages)


#: The rows of ``archive``, for DuckDB.
SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, url, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, payload_bytes, payload_digest
FROM q
"""
