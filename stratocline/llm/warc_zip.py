"""WARC records inside ZIP packages, written and read without extraction.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one
gzip member per record, and ``indexes/index.cdxj``, a line per record with its
place.  The reader parses the end record, the ZIP64 locator and end record and the
central directory from the tail of the file, finds the stored members through
their local headers, reads the index member by its byte range, and then reads
records by range, many neighbours at once.

Scale: every input partition writes packages of bounded size to the shared folder
under fresh names; only names that a successful task returned are listed, so a
task that runs again leaves no doubles.  Reading is dealt out by byte ranges, not by
packages.  Payloads are never shuffled by digest: only (id, digest) is aggregated.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import cut, shared_dir, table

ROLL_BYTES = 16 << 20  # of records before a new package begins
RANGE_BYTES = 4 << 20  # of neighbouring records that one read fetches
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
DATA_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdxj"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# --- ZIP ---------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]], *, zip64: bool = True) -> bytes:
    """A package of stored members; with ``zip64`` sizes and offsets stand in ZIP64 fields."""
    out, directory = io.BytesIO(), io.BytesIO()
    for name, data in members:
        raw, at, crc, size = name.encode(), out.tell(), zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
        shown = 0xFFFFFFFF if zip64 else size
        version = 45 if zip64 else 20
        out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, version, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra)) + raw + extra + data)
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if zip64 else b""
        directory.write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, version, version, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if zip64 else at) + raw + extra)
    at, listed, n = out.tell(), directory.getvalue(), len(members)
    out.write(listed)
    if zip64:
        end = out.tell()
        out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(listed), at))
        out.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    else:
        out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, len(listed), at, 0))
    return out.getvalue()


class Member(NamedTuple):
    name: str
    method: int
    start: int
    size: int
    crc: int


def _at(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


def zip_members(f) -> list[Member]:
    """The members of a package, by range reads only; ``start`` is where the member's bytes begin."""
    total = f.size()
    tail_at = max(0, total - 65_557)
    tail = _at(f, tail_at, total - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, at):
        signature, _, end64, _ = struct.unpack("<IIQI", _at(f, tail_at + end - 20, 20))
        if signature != 0x07064B50:
            raise ValueError("no ZIP64 locator before the end record")
        record = _at(f, end64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where the locator points")
        count, size, at = struct.unpack_from("<QQQ", record, 32)
    directory, p, found = _at(f, at, size), 0, []
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", directory, p + 16)
        local = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # only the fields that overflow stand here, in this order
                r = q + 4
                if full == 0xFFFFFFFF:
                    full, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", extra, r)[0]
            q += 4 + n
        header = _at(f, local, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        l_name, l_extra = struct.unpack_from("<HH", header, 26)
        found.append(Member(name, method, local + 30 + l_name + l_extra, packed, crc))
        p += 46 + n_name + n_extra + n_comment
    return found


# --- WARC --------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value without line breaks."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 else c for c in value)


def warc_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response with its payload, or where ``refers_to`` is given a revisit without it."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload behind the HTTP headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# --- Spark -------------------------------------------------------------------


def write_packages(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record per row of (page_id, url, html) and returns (path, records, bytes) of the packages.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the smallest
    page_id is the response and the others revisit it.  Null html is an empty payload;
    repeated rows of that id are responses too; a null id is never referred to,
    so rows whose payload only null ids share are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    key = F.sha2(F.col("html").cast("binary"), 256)
    keyed = rows.where(F.octet_length("html") >= min_revisit_bytes).select(key.alias("key"), "page_id")
    first = keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    # narrow on both sides: (key, page_id) meets one row per repeated payload
    again = keyed.join(first, "key").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("again_id"), F.col("key").alias("again_key"), "first").distinct()
    marked = rows.withColumn("key", key)
    marked = marked.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key")), "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        data, index, n = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal data, index, n
            body = zip_stored([(DATA_NAME, data.getvalue()), (INDEX_NAME, "".join(index).encode())])
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(body)
            done = pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": len(body)}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
            data, index, n = io.BytesIO(), [], 0
            return done

        fs.create_dir(base, recursive=True)
        for b in batches:
            for page_id, url, html, refers_to in zip(*[c.to_pylist() if i != 2 else c for i, c in enumerate(b.columns)]):
                record = gzip.compress(warc_record(page_id, url, html.as_py().encode(), refers_to), 4, mtime=0)
                index.append(json.dumps({"id": page_id, "offset": data.tell(), "length": len(record)}) + "\n")
                data.write(record)
                n += 1
                if data.tell() >= ROLL_BYTES:
                    yield close()
        if n:
            yield close()

    return cut(marked.mapInArrow(write, "path string, records long, bytes long"))


RECORDS = "page_id {kind}, url string, record_type string, refers_to {kind}, digest string, payload_bytes long, payload_digest string, payload binary"


def read_packages(packages: DataFrame, *, id_type: str = "bigint", payload: bool = True) -> DataFrame:
    """The records of the packages in column ``path``; without ``payload`` that column is null.

    ``digest`` is what the record's header says, ``payload_bytes`` and
    ``payload_digest`` are computed from the payload read; all three null for revisits
    but for the header's digest.
    """
    as_id = int if id_type in ("bigint", "int") else str

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    members = {m.name: m for m in zip_members(f)}
                    data, listed = members[DATA_NAME], members[INDEX_NAME]
                    if data.method or listed.method:
                        raise ValueError(f"{path}: members are not stored")
                    body = _at(f, listed.start, listed.size)
                if zlib.crc32(body) != listed.crc:
                    raise ValueError(f"{path}: wrong checksum of the index")
                out, begin, end = [], None, 0
                for line in body.splitlines():
                    x = json.loads(line)
                    if begin is None:
                        begin = x["offset"]
                    end = x["offset"] + x["length"]
                    if end - begin >= RANGE_BYTES:
                        out.append({"path": path, "start": data.start + begin, "size": end - begin})
                        begin = None
                if begin is not None:
                    out.append({"path": path, "start": data.start + begin, "size": end - begin})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.int64() if as_id is int else pa.string()
        schema = pa.schema([("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", kind), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

        def ident(value: str | None):
            inner = (value or "")[len("<urn:page:") : -1]
            return as_id(inner) if inner else None

        for b in batches:
            for path, start, size in zip(*[c.to_pylist() for c in b.columns]):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    left = _at(f, start, size)
                out = []
                while left:
                    unzip = zlib.decompressobj(31)
                    headers, body = parse_record(unzip.decompress(left) + unzip.flush())
                    left = unzip.unused_data
                    revisit = headers["warc-type"] == "revisit"
                    out.append({
                        "page_id": ident(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"], "refers_to": ident(headers.get("warc-refers-to")),
                        "digest": headers["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": None if revisit else len(body), "payload_digest": None if revisit else payload_digest(body), "payload": body if payload and not revisit else None,
                    })
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    spans = packages.select("path").mapInArrow(ranges, "path string, start long, size long")
    spans = spans.repartition(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spans.mapInArrow(records, RECORDS.format(kind="bigint" if as_id is int else "string"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the facts of the full payload: a revisit takes those of the response that it refers to."""
    facts = ("payload_bytes", "payload_digest")
    of = records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("of_id"), F.col("digest").alias("of_digest")).agg(*[F.first(c).alias(f"of_{c}") for c in facts])
    joined = records.join(of, (F.col("refers_to") == F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    return joined.select("page_id", *[F.coalesce(c, f"of_{c}").alias(c) for c in facts], "record_type", "refers_to", "url")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    packages = write_packages(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return resolve_revisits(cut(read_packages(packages, id_type=dict(pages.dtypes)["page_id"], payload=False).drop("payload")))


OP3_SQL = r"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, url, octet_length(payload) AS n, sha1(payload) AS hex FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h),
b AS (SELECT *, CAST(('0x' || substr(hex, 1, 10)) AS UBIGINT) AS a1, CAST(('0x' || substr(hex, 11, 10)) AS UBIGINT) AS a2,
    CAST(('0x' || substr(hex, 21, 10)) AS UBIGINT) AS a3, CAST(('0x' || substr(hex, 31, 10)) AS UBIGINT) AS a4 FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform([a1, a2, a3, a4], lambda a: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((a >> CAST(s AS UBIGINT)) % 32 AS INT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to, url
FROM b
"""
