"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs, text blocks and media references
with their captions; media live in a table of their own, keyed by the digest of the
stored bytes.  References are resolved by a join on that digest, and each result
carries the position it came from, so that order and captions stay aligned.

Scale: payloads are never shuffled by :func:`resolve` unless a caller asks for the
payload column; the query joins what it computed from a scan of the stored bytes, a
narrow row per distinct digest.  Equal media share one digest, however many
documents refer to it, and are reduced before the join.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import shared_dir, table

WIDTH = 576
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
BLOCKS = frozenset("address article aside blockquote body dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Sequence(HTMLParser):
    """Collects text blocks and media references in the order of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.skip = self.caption = self.figure = 0
        self.in_figure: list[int] = []

    def flush(self) -> None:
        block = " ".join("".join(self.text).split())
        self.text = []
        if not block:
            return
        if self.caption and self.in_figure:
            for i in self.in_figure:
                self.parts[i]["caption"] = f"{self.parts[i]['caption'] or ''} {block}".strip()
        else:
            self.add("text", block, None)

    def add(self, kind: str, text: str | None, ref: str | None) -> None:
        self.parts.append({"position": len(self.parts), "kind": kind, "text": text, "ref": ref, "caption": None})

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "audio", "video", "source"):
            values = dict(attrs)
            if values.get("src"):
                self.flush()
                self.add("media", values.get("alt"), values["src"])
                if self.figure:
                    self.in_figure.append(len(self.parts) - 1)
        elif tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS or tag == "figcaption":
            self.flush()
            if tag == "figure":
                self.figure, self.in_figure = self.figure + 1, []
            elif tag == "figcaption":
                self.caption += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS or tag == "figcaption":
            self.flush()
            if tag == "figure":
                self.figure = max(0, self.figure - 1)
                self.in_figure = []
            elif tag == "figcaption":
                self.caption = max(0, self.caption - 1)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def parse_sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.parts


def sequences(pages: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """(id, sequence) for each row; null or empty HTML gives an empty sequence; other columns are ignored."""
    kind = dict(pages.dtypes)[id_col]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = pa.array([parse_sequence(h) for h in b.column(1).to_pylist()], pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column(0), seq], names=["id", "sequence"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(parse, f"id {kind}, sequence {SEQUENCE}")


def references(seqs: DataFrame) -> DataFrame:
    """A row per media reference: (id, position, digest, caption); digest is what follows ``sha256:`` in its source."""
    part = F.explode(F.filter("sequence", lambda p: p["kind"] == "media")).alias("part")
    return seqs.select("id", part).select("id", "part.position", F.regexp_extract("part.ref", r"^sha256:([0-9a-f]{64})$", 1).alias("digest"), "part.caption")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of the medium that their digest names; nulls where there is none.

    A digest stands for one content, so repeated media of one digest are reduced to one.
    """
    others = [c for c in media.columns if c != "digest"]
    one = media.groupBy(F.col("digest").alias("m_digest")).agg(*[F.first(c).alias(c) for c in others])
    return refs.join(one, F.col("digest") == F.col("m_digest"), "left").drop("m_digest")


def to_payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 with bytes 255 up to a positive multiple of the width."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A greyscale image of 8-bit samples, ``WIDTH`` to a row."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _png_chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; raises on a wrong signature or checksum."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        size = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("wrong checksum in a PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    return lines[:, 1:].tobytes()


def features_of(media: bytes) -> dict:
    payload = from_png(media)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum()) / len(payload)
    entropy = float(-(share * np.log2(share)).sum())
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{WIDTH}x{len(payload) // WIDTH} mean {mean:.3f} entropy {entropy + 0.0:.4f} levels {len(share)}",
    }


def store(docs: DataFrame, folder: str) -> None:
    """Writes (id, html, digest, media): a page for each document that refers to its text's image by digest."""
    kind = dict(docs.dtypes)["doc_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                out: tuple[list, ...] = ([], [], [])
                for text in b.column(1).to_pylist():
                    n, payload = to_payload(text)
                    media = to_png(payload)
                    digest = hashlib.sha256(media).hexdigest()
                    page = f'<article><p>{escape("A text as an image.")}</p><figure><img src="sha256:{digest}" alt="text"><figcaption>{n} bytes</figcaption></figure></article>'
                    for column, value in zip(out, (page, digest, media)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["id", "html", "digest", "media"])

    made = docs.select("doc_id", "text").mapInArrow(build, f"id {kind}, html string, digest string, media binary")
    made.write.option("compression", "snappy").option("parquet.block.size", 32 << 20).mode("overwrite").parquet(folder)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """(digest, features) of each stored row, computed from the bytes read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features_of(m.as_py()) for m in b.column(1)]
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[n] for r in rows], t) for n, t in zip(names, types)]], names=["digest", *names])

    return media.select("digest", "media").mapInArrow(read, f"digest string, {FEATURES}")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; ids may be null or repeated (a row each); an empty table gives no rows."""
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store(table(spark, sf_dir, "documents"), folder)
    stored = spark.read.parquet(folder)
    refs = references(sequences(stored, id_col="id", html_col="html"))
    found = resolve(refs, media_features(stored))
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return found.select(F.col("id").alias("doc_id"), n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
