"""Near-duplicate documents by SetSketch registers.

Each element of a document's shingle set meets every register once, at values that
ascend through equal slices of probability (truncated exponential variates); a
register keeps the least value and stores it on a scale of powers of ``BASE``, cut
off at both ends.  Sketches of parts merge by the maximum of their registers, and two
documents agree in a register about as often as their sets' Jaccard similarity.

Bands of registers propose pairs; the three counts of equal, greater and smaller
registers give the likelihood of each similarity, jointly with both set sizes, and
pairs for which the threshold is out of the question are dropped; what is left is
verified on the full shingle sets of the texts.

Scale: exact copies are one node.  Only sketches (260 bytes a document) and 16-byte
bucket rows are shuffled, and the texts of documents in candidate pairs, once
by id.  Members of a bucket that its pivot leaves apart bring the hashes of their whole
sets to its blocks (longer sets their sketch alone), so that a large group of copies
which are almost similar enough sends no pairs on.  With 32 bands of 4 registers a pair of similarity 0.8 shares no bucket
with probability 5e-8; the likelihood test rejects it with probability 4e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import cut, table, text_key
from stratocline.llm.hashing import mix64, shingle_sets, slices
from stratocline.llm.linking import PACKED, band_keys, bucket_key, buckets, first_shared, link, packed, ranges, shared

REGISTERS, BANDS, ROWS = 128, 32, 4
BASE, RATE, LIMIT = 1.001, 20.0, 65_534
IN_BLOCK = 4096  # shingles of a document whose set goes to the blocks of its buckets with its sketch
BROADCAST_IDS = 250_000  # ids of candidate documents (some 100 bytes each in a hash table) that may be broadcast
DOUBT = 10.0  # by which the log likelihood of the best similarity must exceed the threshold's for a pair to be dropped
HEAD = 8 + 2 * REGISTERS  # bytes of a set's size and sketch
_GOLD, _SALT = 0x9E3779B97F4A7C15, np.uint64(0x5851F42D4C957F2D)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (n, REGISTERS) as unsigned 16-bit integers; empty sets have zeros."""
    m = REGISTERS
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least = np.ones(len(sets) * m)  # of 1 - exp(-RATE * value)
    spread = mix64(x ^ _SALT)
    first, step = (spread & np.uint64(m - 1)).astype(np.int64), ((spread >> np.uint64(16)).astype(np.int64) & (m - 1)) | 1
    base = owner * m
    for j in range(m):
        if j:
            open_ = least.reshape(-1, m).max(1) > j / m
            stay = open_[owner]
            if not stay.all():
                x, owner, first, step, base = x[stay], owner[stay], first[stay], step[stay], base[stay]
        if not len(x):
            break
        u = (mix64(x + np.uint64((j + 1) * _GOLD % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        u += j
        u /= m
        np.minimum.at(least, base + ((first + j * step) & (m - 1)), u)
    value = -np.log1p(-np.minimum(least, 1 - 1e-16)) / RATE
    k = np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE))
    out = np.clip(k, 0, LIMIT + 1).astype(np.uint16).reshape(-1, m)
    out[[len(s) == 0 for s in sets]] = 0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 201)


def log_likelihood(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Log likelihood (pairs, grid) of the similarities 0, 0.005, ... 1 that set sizes allow, from register comparisons."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    share = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    # P(register of a greater) = p(u - vJ), of b p(v - uJ), with p(x) = -log_b(1 - x (b - 1) / b)
    up, down = (-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE) for x in (u - v * share, v - u * share))
    same = np.clip(1 - up - down, 1e-12, None)
    return greater[:, None] * np.log(np.maximum(up, 1e-12)) + less[:, None] * np.log(np.maximum(down, 1e-12)) + equal[:, None] * np.log(same)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair, and whether ``threshold`` or more is possible."""
    best, able = np.empty(len(a)), np.empty(len(a), bool)
    for s in range(0, len(a), 2048):
        x, y = a[s : s + 2048], b[s : s + 2048]
        like = log_likelihood((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), n_a[s : s + 2048].astype(float), n_b[s : s + 2048].astype(float))
        best[s : s + 2048] = _GRID[like.argmax(1)]
        able[s : s + 2048] = like[:, _GRID >= threshold - 1e-9].max(1) >= like.max(1) - DOUBT
    return best, able


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def set_id(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a set in two halves."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, hi, lo, n, sketch) per row: digest, size and sketch of its set; null, null, 0, null for texts without words."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "text_key", "hi", "lo", "n", "sketch"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                sets = shingle_sets([_raw(t.as_py()) for t in b.column(1)], width)
                registers = sketches(sets)
                ids = [set_id(x) if len(x) else (None, None) for x in sets]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(2), pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([r.tobytes() if len(x) else None for r, x in zip(registers, sets)], pa.binary()),
                ], names=names)

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(build, f"doc_id {kind}, text_key long, hi long, lo long, n long, sketch binary")


def _similar(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingles(text: str | None, width: int) -> set:
    """The shingle set itself, of words as they are."""
    words = _raw(text).lower().split()
    return {tuple(words)} if 0 < len(words) < width else set(zip(*(words[k:] for k in range(width))))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text).

    Rows without words (null and empty texts too) are linked with nothing.  Repeated
    ids are rows of their own; the one id then stands for all of them.  A row with a
    null id links others but names no component: it has the component's smallest
    id, null if there is none, and is never kept unless its component has no id.
    """
    return judged(docs, width=width, percent=percent).drop("text_key")


def judged(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """As ``near_duplicates``, with the ``text_key`` of each row, which tells rows of one id apart."""
    docs = docs.select("doc_id", "text")
    rows = cut(sketched(docs, width))
    facts = F.min(F.struct("doc_id", "n", "sketch", "text_key"))  # nulls come first in a struct, so ids are told apart below
    named = rows.where(F.col("hi").isNotNull())
    repeats = bool(named.groupBy("doc_id", "text_key").count().where(F.col("count") > 1).take(1))  # rows that are equal
    one = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "sketch", "text_key"))), facts)
    # equal sets are one node; written, so that its number stays
    nodes = cut(named.groupBy("hi", "lo").agg(one.alias("f")).select(F.monotonically_increasing_id().alias("node"), "hi", "lo", F.col("f.doc_id").alias("first"), F.col("f.text_key").alias("first_key"), "f.n", "f.sketch"))
    parts = ranges(nodes.count() * BANDS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                registers = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                yield from packed(b.column(0).to_numpy(zero_copy_only=False), band_keys(registers, BANDS, ROWS), parts)

    @F.pandas_udf("boolean")
    def possible(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        left, right = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), REGISTERS) for x in (a, b))
        return pd.Series(estimate(left, right, n_a.to_numpy(), n_b.to_numpy(), percent / 100)[1])

    def compare(payloads: list[bytes], x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Of pairs of sketches, with sets of hashes cut to 32 bits: whether their similarity may reach the threshold."""
        rows = np.frombuffer(b"".join(p[:HEAD] for p in payloads), np.uint16).reshape(len(payloads), HEAD // 2)
        size = np.ascontiguousarray(rows[:, :4]).view(np.int64).ravel()
        good = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
        good &= first_shared(bucket_key(band_keys(rows[:, 4:], BANDS, ROWS).ravel(), parts).reshape(len(rows), BANDS), x, y, key)
        at = np.flatnonzero(good)
        left, right = rows[x[at], 4:], rows[y[at], 4:]
        # far fewer equal registers than the threshold needs: the likelihood would say the same
        some = (left == right).sum(1) >= REGISTERS * (percent / 100 - 0.3)
        good[at[~some]] = False
        at = at[some]
        if len(at):
            good[at] = estimate(left[some], right[some], size[x[at]], size[y[at]], percent / 100)[1]
        at = np.flatnonzero(good & (size[x] <= IN_BLOCK) & (size[y] <= IN_BLOCK))
        if len(at):
            both = shared([np.frombuffer(p, np.uint32, offset=HEAD) for p in payloads], x[at], y[at])
            # hashes that collide add to what is shared, so no link is lost here
            good[at] = 100 * both >= percent * (size[x[at]] + size[y[at]] - both)
        return good

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                sets = [x for x in shingle_sets([_raw(t.as_py()) for t in b.column(0)], width) if len(x)]
                made = [np.int64(len(x)).tobytes() + r.tobytes() + (np.sort((x >> np.uint64(32)).astype(np.uint32)).tobytes() if len(x) <= IN_BLOCK else b"") for x, r in zip(sets, sketches(sets))]
                ids = [set_id(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array([i[k] for i in ids], pa.int64()) for k in (0, 1)] + [pa.array(made, pa.binary())], names=["hi", "lo", "payload"])

    def texts_of(ids: DataFrame) -> DataFrame:
        """The rows of distinct (n_id, n_key); texts are shuffled only where the ids are too many to go to all tasks."""
        return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("n_id")) & (text_key(F.col("text")) == F.col("n_key")), "left_semi")

    def payload(wanted: DataFrame) -> DataFrame:
        wanted = cut(nodes.join(wanted, "node").select("node", "hi", "lo", F.col("first").alias("n_id"), F.col("first_key").alias("n_key")))
        made = texts_of(wanted.select("n_id", "n_key").distinct()).select("text").mapInArrow(loads, "hi long, lo long, payload binary")
        return wanted.select("node", "hi", "lo").join(made.dropDuplicates(["hi", "lo"]), ["hi", "lo"]).select("node", "payload")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            good = []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last[0] != b:
                    last = (b, shingles(text_b.as_py(), width))
                if _similar(shingles(text_a.as_py(), width), last[1], percent):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def confirm(pairs: DataFrame) -> DataFrame:
        side = [nodes.select(F.col("node").alias(x), F.col("first").alias(f"id_{x}"), F.col("first_key").alias(f"key_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"]
        near = pairs.join(side[0], "a").join(side[1], "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        near = near.where(possible("s_a", "s_b", "n_a", "n_b")).select("a", "b", "id_a", "id_b", "key_a", "key_b")
        near = cut(near)
        ids = near.select(F.col("id_a").alias("n_id"), F.col("key_a").alias("n_key")).unionByName(near.select(F.col("id_b").alias("n_id"), F.col("key_b").alias("n_key"))).distinct()
        wanted = texts_of(ids).withColumn("key", text_key(F.col("text")))
        if repeats:
            wanted = wanted.dropDuplicates(["doc_id", "key"])
        text = [wanted.select(F.col("doc_id").alias(f"t_{x}"), F.col("key").alias(f"k_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab"]
        full = near.join(text[0], F.col("id_a").eqNullSafe(F.col("t_a")) & (F.col("key_a") == F.col("k_a"))).select("a", "b", "id_b", "key_b", "text_a")
        full = full.join(text[1], F.col("id_b").eqNullSafe(F.col("t_b")) & (F.col("key_b") == F.col("k_b"))).select("a", "b", "text_a", "text_b")
        return full.mapInArrow(verify, "a long, b long").distinct()

    comps = link(cut(buckets(nodes.select("node", "sketch").mapInArrow(keyed, PACKED))), confirm, payload, compare)
    labelled = cut(nodes.select("node", "hi", "lo", "first").join(comps, "node", "left").select("node", "hi", "lo", "first", F.coalesce("comp", "node").alias("comp")))
    lowest = labelled.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_node = labelled.join(lowest, "comp").select(F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo"), "component_id")
    out = rows.select("doc_id", "text_key", "hi", "lo", "n").join(of_node, (F.col("hi") == F.col("l_hi")) & (F.col("lo") == F.col("l_lo")), "left")
    component = F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.c AS component_id, d.doc_id = k.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) k ON k.doc_id = d.doc_id
"""
