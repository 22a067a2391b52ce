"""Fuzzy line deduplication by MinHash over character shingles.

Lines are compared with A-Z lower-cased and white space collapsed.  A line's
signature is a one-permutation MinHash of its ``CHARS``-character shingles (each
shingle hashed once, the least hash of each bin, empty bins filled from others by
fixed random choice); bands of it propose pairs, exact Jaccard similarity of the
shingle sets verifies them, and connected components keep one line each: the first
in the order of (doc_id, line number).  With 24 bands of 4 bins, a pair of
similarity 0.8 is missed with probability 3e-6, were the bins independent.

Scale: texts are cut into lines, hashed and signed in numpy over whole batches.  Bucket
entries are packed, and exact copies of a line meet as one entry per task and batch.
Lines are told apart by 128-bit digests.  Line texts are fetched for candidates only,
once for each distinct line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import cut, discard, spare, table, text_key
from stratocline.llm.hashing import char_shingles, line_digests, line_spans, mix64, normal_line, slices
from stratocline.llm.linking import PACKED, band_keys, bucket_key, buckets, first_shared, link, packed, ranges, shared

CHARS, BANDS, ROWS, PERCENT = 9, 24, 4, 80
BINS = BANDS * ROWS
LEAST_BINS = BINS // 2  # bins in which lines agree at least if they are similar: 77 of 96, give or take 4, are expected at the threshold
IN_BLOCK = 4096  # shingles of a line whose set, cut to 16 bits, goes to the blocks of its buckets
DOUBT = 3  # shingles from the threshold within which a pair is decided by its shingles, beyond by their 64-bit hashes
LINE_BYTES = 200  # of a line, by which the number of key ranges is chosen
HEAD = 8 + 2 * BINS  # bytes of a set's size and its bins
BROADCAST_LINES = 200_000  # places of lines (some 150 bytes each in a hash table) that may be broadcast
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LINES = pa.list_(pa.struct([("line", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())]))
_PACKED = [("part", pa.int32()), ("heads", pa.binary()), ("near", pa.binary())]


def _spans(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines as spans of one array of codes."""
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _signatures(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least hash in each bin (n, BINS) of lines that are not empty, cut to 16 bits; empty bins are filled from others."""
    out = np.full((len(starts) + 1, BINS), _EMPTY)
    flat = out.reshape(-1)
    for owners, counts, h in char_shingles(codes, starts, ends, CHARS):
        where = h >> np.uint64(32)
        where *= np.uint64(BINS)
        where >>= np.uint64(32)
        where = where.view(np.int64)
        where += np.repeat(owners * BINS, counts)
        np.minimum.at(flat, where, h)
    out = out[:-1]
    row, column = np.nonzero(out == _EMPTY)
    if len(row):
        source = out.copy()
        attempt = 0
        while len(row):
            attempt += 1
            other = (mix64(np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * 1_000_003)) % np.uint64(BINS)).astype(np.int64)[column]
            value = source[row, other]
            done = value != _EMPTY
            out[row[done], column[done]] = value[done]
            row, column = row[~done], column[~done]
    return out.astype(np.uint16)


def hashed_sets(raw: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each line's shingles."""
    hashes: list[list[np.ndarray]] = [[] for _ in raw]
    for owners, counts, h in char_shingles(*_spans(raw), CHARS):
        for i, e, n in zip(owners.tolist(), np.cumsum(counts).tolist(), counts.tolist()):
            if i < len(raw) and n:
                hashes[i].append(h[e - n : e])
    return [np.unique(np.concatenate(x)) if len(x) > 1 else _distinct(x[0]) for x in hashes]


def _distinct(values: np.ndarray) -> np.ndarray:
    out = np.sort(values)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signatures(lines: list[str]) -> np.ndarray:
    return _signatures(*_spans([x.encode("utf-8", "replace") for x in lines]))


def shingles(line: str) -> set[str]:
    return {line[i : i + CHARS] for i in range(max(1, len(line) - CHARS + 1))}


def _similar(a: set, b: set) -> bool:
    both = len(a & b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _lines(text: str | None) -> list[tuple[int, str]]:
    """(number, normal form) of the lines that are not blank."""
    found = ((i, normal_line(x)) for i, x in enumerate((text or "").encode("utf-8", "replace").split(b"\n")))
    return [(i, x.decode("utf-8", "replace")) for i, x in found if x]


def _scanned(docs: DataFrame, parts: int) -> DataFrame:
    """One pass over all texts: rows (doc_id, text_key, lines) with number and 128-bit digest, in two halves, of each line that is not blank, and rows of ``PACKED``.

    The latter are bucket entries of the distinct lines of each batch; a line is named by the first half of its digest there.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spec = pa.schema([("doc_id", b.schema.field(0).type), ("text_key", pa.int64()), ("lines", _LINES), *_PACKED])

            def filled(columns: dict, n: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in spec], schema=spec)

            def entries(nodes: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                for made in packed(np.concatenate(nodes), np.concatenate(keys), parts):
                    yield filled(dict(zip(made.schema.names, made.columns)), made.num_rows)

            rows, numbers, digests = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
            nodes, keys, held = [], [], 0
            for row, number, codes, starts, ends in line_spans(b.column(1)):
                digest = line_digests(codes, starts, ends)
                rows.append(row)
                numbers.append(number)
                digests.append(digest)
                first = np.sort(np.unique(digest[:, 0], return_index=True)[1])
                for s in range(0, len(first), 2048):
                    pick = first[s : s + 2048]
                    nodes.append(digest[pick, 0])
                    keys.append(band_keys(_signatures(codes, starts[pick], ends[pick]), BANDS, ROWS))
                    held += len(pick)
                    if held >= 8192:
                        yield from entries(nodes, keys)
                        nodes, keys, held = [], [], 0
            if held:
                yield from entries(nodes, keys)
            digest = np.concatenate(digests)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(rows), minlength=b.num_rows))]).astype(np.int32)
            columns = (np.concatenate(numbers).astype(np.int32), np.ascontiguousarray(digest[:, 0]), np.ascontiguousarray(digest[:, 1]))
            lines = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["line", "hi", "lo"]))
            yield filled({"doc_id": b.column(0), "text_key": b.column(2), "lines": lines.cast(_LINES)}, b.num_rows)

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(build, f"doc_id {kind}, text_key long, lines array<struct<line int, hi long, lo long>>, {PACKED}")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, dropped array<int>): the line numbers, from 0, that go from each document that loses any.

    A line goes if a similar one, directly or through others, stands earlier in the
    order of (doc_id, line), null ids first.  Rows of one id are told apart by
    ``text_key``, equal rows count as one document; blank lines are never dropped; null and empty texts have no lines.
    """
    return _gone(docs.select("doc_id", "text"))[1]


def _gone(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written occurrences of lines, and what ``dropped_lines`` returns."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = ranges(size // LINE_BYTES * BANDS)
    scan = cut(_scanned(docs, parts))
    near = cut(buckets(scan.where("part IS NOT NULL").select("part", "heads", "near")))
    places = cut(scan.where("lines IS NOT NULL").select("doc_id", "text_key", "lines"))
    discard(scan)
    lines = places.select("doc_id", "text_key", F.inline("lines"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                node, text = [], []
                for t, wanted in zip(b.column(0), b.column(1).to_pylist()):
                    own = (t.as_py() or "").encode("utf-8", "replace").split(b"\n")
                    for w in wanted:
                        node.append(w["node"])
                        text.append(normal_line(own[w["line"]]))
                bins = _signatures(*_spans(text))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(text, pa.binary()), pa.array([x.tobytes() for x in bins], pa.binary())], names=["node", "text", "bins"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            good = []
            p, q = (np.frombuffer(b"".join(whole.column(i).to_pylist()), np.uint16).reshape(-1, BINS) for i in (4, 5))
            for batch in slices(whole.take(pa.array(np.flatnonzero((p == q).sum(1) >= LEAST_BINS))), 2):
                a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                ids, at = np.unique(np.concatenate([a, b]), return_index=True)
                both = [*batch.column(2), *batch.column(3)]
                raw = [both[i].as_py() for i in at.tolist()]
                sets = hashed_sets(raw)
                x, y, size = np.searchsorted(ids, a), np.searchsorted(ids, b), np.array([len(s) for s in sets], np.int64)
                common = shared(sets, x, y)
                over = 100 * common - PERCENT * (size[x] + size[y] - common)
                similar = over >= 0
                for i in np.flatnonzero(np.abs(over) <= 100 * DOUBT).tolist():
                    # here two hashes that collide might decide: the shingles themselves do
                    similar[i] = _similar(shingles(raw[x[i]].decode("utf-8", "replace")), shingles(raw[y[i]].decode("utf-8", "replace")))
                good += zip(a[similar].tolist(), b[similar].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                raw = [x.as_py() for x in b.column(1)]
                out = []
                for x, own in zip(_signatures(*_spans(raw)), hashed_sets(raw)):
                    out.append(np.int64(len(own)).tobytes() + x.tobytes() + (np.sort(own.astype(np.uint16)).tobytes() if len(own) <= IN_BLOCK else b""))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "payload"])

    def compare(payloads: list[bytes], x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Of pairs of lines: whether they may be similar; those that agree in less than two fifths of their bins are not."""
        head = np.frombuffer(b"".join(p[:HEAD] for p in payloads), np.uint8).reshape(len(payloads), HEAD)
        size = np.ascontiguousarray(head[:, :8]).view(np.int64).ravel()
        bins = np.ascontiguousarray(head[:, 8:]).view(np.uint16)
        good = 100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])
        good &= first_shared(bucket_key(band_keys(bins, BANDS, ROWS).ravel(), parts).reshape(len(bins), BANDS), x, y, key)
        at = np.flatnonzero(good)
        good[at] = (bins[x[at]] == bins[y[at]]).sum(1) >= LEAST_BINS
        at = np.flatnonzero(good & (size[x] <= IN_BLOCK) & (size[y] <= IN_BLOCK))
        if len(at):
            both = shared([np.frombuffer(p, np.uint16, offset=HEAD) for p in payloads], x[at], y[at])
            # hashes that collide add to what is shared, so no link is lost here
            good[at] = 100 * both >= PERCENT * (size[x[at]] + size[y[at]] - both)
        return good

    wanted = near.select(F.col("node").alias("w_hi")).unionByName(near.select(F.col("pivot").alias("w_hi"))).distinct()
    wanted = cut(wanted)
    often = lines.groupBy(F.col("hi").alias("w_hi")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("w_hi")
    # lines that share a bucket or repeat: all others stay as they are
    lines = cut(lines.join(wanted.unionByName(often).hint("shuffle_hash"), F.col("hi") == F.col("w_hi"), "left_semi"))
    # those that share a bucket, each with a number of its own and the first place where it stands
    place = F.min(F.struct("doc_id", "line", "text_key")).alias("first")
    some = cut(lines.join(wanted, F.col("hi") == F.col("w_hi")).groupBy("hi", "lo").agg(place).select(F.monotonically_increasing_id().alias("number"), "hi", "lo", "first"))
    by_doc = some.groupBy(F.col("first.doc_id").alias("w_id"), F.col("first.text_key").alias("w_key")).agg(F.collect_list(F.struct(F.col("number").alias("node"), F.col("first.line").alias("line"))).alias("wanted"))
    by_doc = F.broadcast(by_doc) if some.count() <= BROADCAST_LINES else by_doc
    held = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("w_id")) & (text_key(F.col("text")) == F.col("w_key"))).select("text", "wanted")
    texts = held.mapInArrow(fetch, "node long, text binary, bins binary")
    if places.groupBy("doc_id", "text_key").count().where(F.col("count") > 1).take(1):  # rows that are equal
        texts = texts.dropDuplicates(["node"])
    texts = cut(texts)
    def confirm(pairs: DataFrame) -> DataFrame:
        side = [texts.select(F.col("node").alias(n), F.col("text").alias(t), F.col("bins").alias(f"bins_{n}")) for n, t in ("ax", "by")]
        full = pairs.join(side[0], "a").join(side[1], "b")
        return full.select("a", "b", "x", "y", "bins_a", "bins_b").mapInArrow(verify, "a long, b long")

    names = some.select(F.col("hi").alias("name"), F.col("number").alias("node"))
    comps = link(near, confirm, lambda nodes: texts.join(nodes, "node").select("node", "text").mapInArrow(loads, "node long, payload binary"), compare, names)
    # only lines that repeat or are linked can lose anything; a line that is not linked is named by its digest
    linked = some.join(comps, F.col("number") == F.col("node")).select("hi", "lo", "comp")
    repeated = lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("hi", "lo", F.lit(None).cast("long").alias("comp"))
    named = linked.unionByName(repeated).groupBy("hi", "lo").agg(F.max("comp").alias("comp"))
    group = F.when(F.col("comp").isNotNull(), F.struct(F.col("comp").alias("x"), F.lit(None).cast("long").alias("y"))).otherwise(F.struct(F.col("hi").alias("x"), F.col("lo").alias("y")))
    named = named.select(F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo"), group.alias("g")).select("n_hi", "n_lo", F.col("g.x").alias("g_x"), F.col("g.y").alias("g_y"))
    found = cut(lines.join(named, (F.col("hi") == F.col("n_hi")) & (F.col("lo") == F.col("n_lo"))).select("doc_id", "text_key", "line", "g_x", "g_y"))
    keeper = found.groupBy(F.col("g_x").alias("k_x"), F.col("g_y").alias("k_y")).agg(F.min(F.struct("doc_id", "line", "text_key")).alias("keep"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line") == F.col("keep.line")) & (F.col("text_key") == F.col("keep.text_key"))
    gone = found.join(keeper, (F.col("g_x") == F.col("k_x")) & F.col("g_y").eqNullSafe(F.col("k_y"))).where(~kept)
    return places, gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without their dropped lines; documents that lose all their words go, others keep their columns.

    ``n_chars``, where there is such a column, is counted again for texts that change.
    """
    gone = dropped.select(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key"), F.col("dropped").alias("d_lines"))
    numbers, text = gone["d_lines"], docs["text"]
    whole = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), numbers)
    rest = F.array_join(F.transform(stay, lambda i: F.get(whole, i)), "\n")
    name = spare(docs, "rest")
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["d_id"]) & (text_key(text) == gone["d_key"]), "left").select(*[docs[c] for c in docs.columns], numbers.isNotNull().alias(spare(docs, "changed")), F.when(numbers.isNull(), text).otherwise(rest).alias(name))
    changed = F.col(spare(docs, "changed"))
    left = left.where(~changed | F.regexp_like(F.col(name), F.lit(r"\S")))
    new = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(name).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return left.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines: how many it has, how many stay, and the numbers of those that go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places, gone = _gone(docs)
    lines = places.select("doc_id", F.col("text_key").alias("key"), F.size("lines").cast("long").alias("n_lines"))
    joined = lines.join(gone.withColumnsRenamed({"doc_id": "g_id", "text_key": "g_key"}), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))
