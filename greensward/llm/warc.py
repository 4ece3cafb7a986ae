"""Web archives in ZIP packages: a writer, and a reader that never extracts.

A package holds stored members: archive/data.warc.gz (WARC/1.1 records, one gzip member each) and
indexes/index.cdx (a line of JSON per record with offset and length). The reader reads the end of the file for the
(ZIP64) end-of-central-directory records, the central directory, the local header of each stored member, then the
index, and then each record's byte range. Files are reached through pyarrow's file systems in the shared folder.

Of records with equal payloads of at least `least` bytes that with the largest page_id is a response, the others
are revisits that refer to it and carry only the HTTP head. Rows that repeat the largest page_id are responses all.
A null payload is an empty one; a null page_id gives a record without an identifier (a response unless another row
of its group has one). Several attempts of a task write files of different names; only those of the manifest count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, staged, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STORED = 0


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# -- records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record, as a gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [("WARC-Type", "revisit" if revisit else "response")]
    head += [("WARC-Record-ID", f"<urn:page:{page_id}>")] * (page_id is not None)
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~-._")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] * revisit
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))]) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @staticmethod
    def parse(member: bytes) -> Record:
        raw = zlib.decompress(member, wbits=31)
        at = raw.index(b"\r\n\r\n") + 4
        lines = raw[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record at this offset")
        headers = Record._fields(lines[1:])
        block = raw[at : at + int(headers["content-length"])]
        body = block.index(b"\r\n\r\n") + 4
        return Record(headers, Record._fields(block[:body].decode().split("\r\n")[1:]), block[body:])

    @staticmethod
    def _fields(lines: list[str]) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}

    def page(self, field: str) -> int | None:
        value = self.headers.get(field)
        return int(value.rpartition(":")[2].rstrip(">")) if value else None

    def digest(self) -> str:
        return base64.b32decode(self.headers["warc-payload-digest"].partition(":")[2]).hex()


# -- packages


class Package:
    """Writes one package; its members are stored, so that record offsets hold within the file."""

    def __init__(self) -> None:
        self.data, self.lines, self.rows = io.BytesIO(), [], 0

    def add(self, page_id: int | None, member: bytes) -> None:
        self.lines.append(json.dumps({"page": page_id, "offset": self.data.tell(), "length": len(member)}))
        self.data.write(member)
        self.rows += 1

    def write(self, folder: str) -> tuple[str, int, int]:
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, place = file_system(path)
        with fs.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in ((ARCHIVE, self.data.getbuffer()), (INDEX, "\n".join(self.lines).encode())):
                z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), content)
        return path, self.data.tell(), self.rows


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


def central_directory(f, size: int) -> list[Member]:
    """Members of a ZIP file by its central directory, with ZIP64 records where they are needed."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", locator[8:16])
        count, length, at = struct.unpack("<QQQ", read(end64, 56)[32:56])
    directory, members, p = read(at, length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack("<H", directory[p + 10 : p + 12])
        packed, full, n, extra, comment = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        (header_at,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n].decode()
        more = directory[p + 46 + n : p + 46 + n + extra]
        while len(more) >= 4:
            kind, k = struct.unpack("<HH", more[:4])
            if kind == 1:  # ZIP64: only the fields that don't fit, in this order
                values = list(struct.unpack(f"<{min(k, 24) // 8}Q", more[4 : 4 + min(k, 24) // 8 * 8]))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header_at = values.pop(0) if header_at == 0xFFFFFFFF else header_at
            more = more[4 + k :]
        members.append(Member(name, method, packed, header_at))
        p += 46 + n + extra + comment
    return members


def data_at(f, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != STORED:
        raise ValueError(f"{member.name} isn't stored; records can't be read by range")
    f.seek(member.header_at)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return member.header_at + 30 + sum(struct.unpack("<HH", head[26:30]))


def records(path: str) -> Iterator[tuple[int, Record]]:
    """Each record of a package with its offset in the file, by ranges."""
    fs, place = file_system(path)
    with fs.open_input_file(place) as f:
        members = central_directory(f, f.size())
        data = {m.name: data_at(f, m) for m in members if m.name.startswith(("archive/", "indexes/"))}
        index = next(m for m in members if m.name == INDEX)
        f.seek(data[INDEX])
        for line in f.read(index.size).splitlines():
            entry = json.loads(line)
            at = data[ARCHIVE] + entry["offset"]
            f.seek(at)
            yield at, Record.parse(f.read(entry["length"]))


# -- tables


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, refers_to); refers_to is null for responses. Groups of equal payloads are found by (digest, page_id) rows; payloads
    are dealt by page and digest, so a payload that very many pages share doesn't meet in one task."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    first = large.groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = large.select("page_id", F.sha1("payload").alias("digest")).join(first, "digest").where("NOT page_id <=> first")
    refers = refers.select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "first").distinct()
    keyed = rows.withColumn("digest", F.expr(f"CASE WHEN octet_length(payload) >= {least} THEN sha1(payload) END"))
    return keyed.join(refers, F.expr("page_id <=> of_page AND digest = of_digest"), "left").select("page_id", "url", "payload", F.col("first").alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, roll_bytes: int = 32_000_000) -> DataFrame:
    """Write (page_id, url, payload, refers_to) as packages into folder; the manifest (path, data_bytes, n_records), staged."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = Package()
        made = []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                package.add(page_id, record(page_id, url, payload, refers_to, refers_to is not None))
                if package.data.tell() >= roll_bytes:
                    made.append(package.write(folder))
                    package = Package()
        if package.rows:
            made.append(package.write(folder))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "data_bytes", "n_records"])

    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)
    return staged(rows.mapInArrow(write, "path string, data_bytes long, n_records long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the packages: path, place, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    payload_bytes and payload_digest are those of the full payload also for revisits; a response whose payload
    doesn't have the digest of its header is an error.
    """
    names = ["path", "place", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for at, r in records(path):
                    kind, digest = r.headers["warc-type"], r.digest()
                    if kind == "response" and hashlib.sha1(r.payload).hexdigest() != digest:
                        raise ValueError(f"payload of {path} at {at} is damaged")
                    rows.append((path, at, r.page("warc-record-id"), r.headers.get("warc-target-uri"), kind, r.page("warc-refers-to"), int(r.http["content-length"]), digest, r.payload if with_payload and kind == "response" else None))
                    size += len(r.payload)
                    if size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    tasks = max(1, manifest.count())
    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in zip(names, kinds))
    return manifest.select("path").repartition(tasks).mapInArrow(read, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html", least=1000)
    manifest = write_archives(rows, fresh_path(spark, "archives"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
