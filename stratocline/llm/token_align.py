"""Alignment of two tokenizers over a corpus, and how many documents link each pair of their tokens.

Both tokenizers cover the same bytes of a text (a space before it), so tokens are aligned by byte offsets: where
tokens of both end, a group ends; between neighbouring ends of either lies one link, the pair of tokens that
overlap there.  A pair of ids is packed into one 64-bit key, the first tokenizer's id in the upper half.

Each document's keys are counted once where it is encoded and kept beside it.  Partitions then sum ``np.unique`` counts of their
documents' keys, these partial counts are sorted over the whole corpus by ranges of the upper half, runs of equal keys are
summed, and each range is written as one array of keys, counts and the highest count of the first id: a shard. Documents look
their keys up in the shards, mapped into memory where the shared folder is mounted, by ``searchsorted``.

Scale: texts are encoded once and never shuffled; what is shuffled is a row of 16 bytes per different pair and task, so a pair that
all documents hold arrives once from each task.  All pairs of one first id lie in one shard (at most as many as
the second vocabulary has ids).  Shards are bounded by both vocabularies; the driver holds one row per shard.

Encoding: the second tokenizer has no token with a space after another character, nor with a line feed beside another, so its merges
never cross the places before those; words meet again and again, so each different piece between such places is encoded once
while a worker remembers it.  A vocabulary that breaks this rule is encoded in whole texts.

Edges: null and empty texts, and those that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty string.
Rows with equal or null ids are rows of their own.  The files of both vocabularies must lie on every executor under the paths given.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import cut, shared_dir, table

FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = r" +[^ \n]*|\n[^ \n]*"
SLICE = 2 << 20  # bytes of text that are aligned in one step, or one longer text
REMEMBERED = 24 << 20  # characters of pieces whose ids a task remembers
HELD = 1 << 21  # keys that a task gathers before it counts them
_FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


class Remembering:
    """Ids of texts by a splitting that tokens never cross: each different piece is encoded once."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[list[int]]]) -> None:
        self.split, self.encode = split, encode
        self.clear()

    def clear(self) -> None:
        self.place, self.used = _Places(), 0
        self.ids, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if self.used > REMEMBERED:
            self.clear()
        pieces = list(map(self.split, texts))
        ends = np.cumsum([0, *map(len, pieces)])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(pieces)), np.int64, int(ends[-1]))
        new = self.place.new
        if new:
            made = self.encode(new)
            size = np.fromiter(map(len, made), np.int64, len(made))
            base = len(self.ids)
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.int32, int(size.sum()))])
            self.start = np.concatenate([self.start, base + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.used += sum(map(len, new)) + 16 * len(new)
            new.clear()
        size = self.size[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[gathered(self.start[at], size)], np.diff(upto[ends])


class _Places(dict):
    """Numbers pieces as they come; ``new`` lists those that are not encoded yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        at = self[piece] = len(self)
        return at


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of ranges of these starts and sizes, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class Vocabulary:
    """What each token stands for, as one row of bytes with the places of the tokens in it, and the encoder."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[gathered(self.start[ids], self.size[ids])]


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary: those that print stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


@functools.lru_cache(4)
def first_vocabulary(path: str = FIRST) -> Vocabulary:
    """A byte-level vocabulary with merges in the order of its ids, which ``tiktoken`` merges alike and faster; another order is refused.

    Kept by the worker.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in {t["content"] for t in told["added_tokens"]}}
    order = [told["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    if order != sorted(order):
        raise ValueError(f"{path}: merges are not in the order of ids")
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    known = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [known.encode_to_numpy(t, disallowed_special=()) for t in texts]
        return np.concatenate(made).astype(np.int32), np.fromiter(map(len, made), np.int64, len(made))

    return Vocabulary(tokens, encode)


@functools.lru_cache(4)
def second_vocabulary(path: str = SECOND) -> Vocabulary:
    """A piece vocabulary; kept by the worker like the first."""
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [known.id_to_piece(i) for i in range(known.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if known.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    space = known.piece_to_id("▁")
    apart = all("▁" not in p.lstrip("▁") and ("\n" not in p or len(p) == 1) for p in pieces) and not known.is_unknown(space)

    def encode(new: list[str]) -> list[list[int]]:
        # the space that the model adds before a piece is the piece's own first one; before a line feed it is a token to leave out
        made = known.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        return [[space] if p == " " else m if p[0] == " " else m[1:] for p, m in zip(new, made)]

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = known.encode([t[1:] for t in texts], num_threads=1)
        return np.fromiter(chain.from_iterable(made), np.int32), np.fromiter(map(len, made), np.int64, len(made))

    # a lone space before a line feed is a token of its own, as nothing merges with the line feed
    plain = apart and known.encode("\nx", num_threads=1)[:1] == [space]
    return Vocabulary(tokens, Remembering(re.compile(PIECES).findall, encode) if plain else whole)


@functools.lru_cache(2)
def _decimals(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the numbers below ``count``: their digits in rows of eight bytes, which of these are taken with a mark behind, and how many digits."""
    number = np.arange(count)
    size = sum((number >= 10**k).astype(np.int64) for k in range(1, 7)) + 1
    row = np.zeros((count, 8), np.uint8)
    for k in range(7):
        there = size > k
        row[number[there], size[there] - 1 - k] = 48 + number[there] // 10**k % 10
    return row, np.arange(8)[None, :] <= size[:, None], size


def marked(ids: np.ndarray, follow: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal forms of ids below ``count`` with a byte behind each, as bytes in a row, and their lengths."""
    if count > 10**7:
        raise ValueError("ids have more than seven digits")
    digits, taken, size = _decimals(count)
    row, size = digits[ids], size[ids]
    row[np.arange(len(ids)), size] = follow
    return row[taken[ids]], size + 1


def aligned(texts: list[str | None], first: Vocabulary, second: Vocabulary) -> dict[str, list]:
    """The columns of ``_FACTS`` for texts."""
    n = len(texts)
    out = {"n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "groups_sha256": [""] * n, "pairs": [None] * n}
    doc = np.array([k for k, t in enumerate(texts) if t], np.int64)
    if not len(doc):
        return out
    spaced = [" " + texts[k] for k in doc]
    raw = [t.encode("utf-8", "replace") for t in spaced]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    ids, count, fits = [], [], np.ones(len(doc), bool)
    for v in (first, second):
        i, c = v.encode(spaced)
        ids.append(i)
        count.append(c)
        owner = np.repeat(np.arange(len(doc)), c)
        fits &= np.bincount(owner, v.size[i], len(doc)).astype(np.int64) == length
    for k in range(2):  # what does not fit by its length goes before bytes are compared
        ids[k], count[k] = ids[k][np.repeat(fits, count[k])], count[k][fits]
    doc, length = doc[fits], length[fits]
    whole = np.frombuffer(b"".join(r for r, f in zip(raw, fits) if f), np.uint8)
    upto = np.cumsum(length)
    if not len(doc):
        return out
    same = np.ones(len(doc), bool)
    for v, i in zip((first, second), ids):
        same &= np.logical_and.reduceat(v.joined(i) == whole, upto - length)
    if not same.all():
        for k in range(2):
            ids[k], count[k] = ids[k][np.repeat(same, count[k])], count[k][same]
        doc, length = doc[same], length[same]
        upto = np.cumsum(length)
    if not len(doc):
        return out
    total = int(upto[-1])
    ends = [np.zeros(total + 1, bool), np.zeros(total + 1, bool)]
    at = [np.cumsum(v.size[i]) for v, i in zip((first, second), ids)]
    for mark, e in zip(ends, at):
        mark[e] = True
    before = lambda mark: np.cumsum(mark, dtype=np.int32) - mark
    both = np.flatnonzero(ends[0] & ends[1])
    either = np.flatnonzero(ends[0] | ends[1])
    a, b = (i[before(mark)[either]] for i, mark in zip(ids, ends))
    per = lambda where: np.diff(np.searchsorted(where, np.concatenate([[0], upto]), "right"))
    links = per(either)
    for name, value in (("n_a", count[0]), ("n_b", count[1]), ("n_groups", per(both)), ("n_links", links)):
        out[name][doc] = value
    # a group's tokens of the first, then those of the second, each followed by its mark
    groups = before(ends[0] & ends[1])
    group = [groups[e] for e in at]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    follow = [np.where(np.append(g[1:] != g[:-1], True), last, ord(",")) for g, last in zip(group, b"|;")]
    text, size = marked(np.concatenate(ids)[order], np.concatenate(follow)[order], max(len(first.size), len(second.size)))
    stop = np.cumsum(size)[np.cumsum(count[0] + count[1]) - 1]
    text = text.tobytes()
    key = (a.astype(np.int64) << 32) | b
    for k, s, e, p, q in zip(doc.tolist(), np.append(0, stop[:-1]).tolist(), stop.tolist(), (np.cumsum(links) - links).tolist(), np.cumsum(links).tolist()):
        out["groups_sha256"][k] = hashlib.sha256(memoryview(text)[s : e - 1]).hexdigest()
        out["pairs"][k] = packed(*np.unique(key[p:q], return_counts=True))
    return out


def packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending keys with their numbers, compressed: steps of the upper halves, lower halves, numbers."""
    rows = np.stack([np.diff(keys >> 32, prepend=0), keys & 0xFFFFFFFF, times]).astype("<u4")
    return np.uint32(rows.shape[1]).tobytes() + pa.Codec("zstd", compression_level=1).compress(rows.tobytes(), asbytes=True)


def unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(value, "<u4", 1)[0])
    rows = np.frombuffer(pa.Codec("zstd").decompress(value[4:], decompressed_size=12 * n), "<u4").reshape(3, n).astype(np.int64)
    return (np.cumsum(rows[0]) << 32) | rows[1], rows[2]


def encoded(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) per row of (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = first_vocabulary(first), second_vocabulary(second)
        for b in batches:
            texts = b.column(1).to_pylist()
            s = 0
            while s < len(texts):
                e, size = s, 0
                while e < len(texts) and (e == s or size + len(texts[e] or "") <= SLICE):
                    size += len(texts[e] or "")
                    e += 1
                made = aligned(texts[s:e], *vocabularies)
                kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), *(pa.array(v, t) for v, t in zip(made.values(), kinds))], names=["doc_id", *made])
                s = e

    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {kind}, {_FACTS}")


def _summed(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(numbers), len(key)).astype(np.int64)


def partial_counts(rows: DataFrame) -> DataFrame:
    """(key, n, first): documents that hold a key, summed by task."""
    names = ["key", "n", "first"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sums: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
        waiting = 0

        def made() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return _summed([sums[0], key], [sums[1], n])

        def out() -> Iterator[pa.RecordBatch]:
            for s in range(0, len(sums[0]), 1 << 16):
                key, n = (x[s : s + (1 << 16)] for x in sums)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array((key >> 32).astype(np.int32))], names=names)

        for b in batches:
            for value in b.column(0):
                if value.is_valid:
                    held.append(unpacked(value.as_py())[0])
                    waiting += len(held[-1])
                    if waiting > HELD:
                        sums, waiting = made(), 0
                        held.clear()
                        if len(sums[0]) > 2 * HELD:
                            yield from out()
                            sums = (np.empty(0, np.int64), np.empty(0, np.int64))
        if held:
            sums = made()
        yield from out()

    return rows.select("pairs").mapInArrow(count, "key long, n long, first int")


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_shards(counts: DataFrame, folder: str) -> list[tuple[int, int, str]]:
    """Sort partial counts over the corpus, sum runs and write a shard per range; returns (first key, last key, path), in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = [], []
        for b in batches:  # in the order of keys, so a batch's first key may go on the last one's run
            if b.num_rows:
                key, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                key, n = key[at], np.add.reduceat(n, at)
                if keys and keys[-1][-1] == key[0]:
                    numbers[-1][-1] += n[0]
                    key, n = key[1:], n[1:]
                if len(key):
                    keys.append(key)
                    numbers.append(n)
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(numbers)
        at = np.flatnonzero(np.concatenate([[True], (key[1:] >> 32) != (key[:-1] >> 32)]))
        most = np.repeat(np.maximum.reduceat(n, at), np.diff(np.append(at, len(key))))
        where, path = _place(f"{folder}/{uuid.uuid4().hex}.npy")
        with where.open_output_stream(path) as f:
            np.save(f, np.stack([key, n, most]))
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[-1]]), pa.array([path if folder.startswith("/") else f"{folder}/{path.rsplit('/', 1)[-1]}"])], names=["low", "high", "path"])

    where, path = _place(folder)
    where.create_dir(path, recursive=True)
    spread = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(spread, "first").sortWithinPartitions("key").select("key", "n")
    return sorted(tuple(r) for r in ranged.mapInArrow(write, "low long, high long, path string").collect())


class Shards:
    """Counts and highest counts of keys, from arrays that are opened when a key falls into them."""

    def __init__(self, listed: list[tuple[int, int, str]]) -> None:
        self.listed, self.low = listed, np.array([s[0] for s in listed], np.int64)
        self.mapped: dict[int, np.ndarray] = {}

    def _open(self, k: int) -> np.ndarray:
        from pyarrow import fs

        where, path = _place(self.listed[k][2])
        if isinstance(where, fs.LocalFileSystem):
            if k not in self.mapped:
                self.mapped[k] = np.load(path, mmap_mode="r")
            return self.mapped[k]
        with where.open_input_file(path) as f:  # a store without mounts: one shard at a time
            return np.load(pa.PythonFile(f) if not hasattr(f, "read") else f)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending keys that were counted."""
        n, most = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        edges = np.append(np.searchsorted(keys, self.low), len(keys))
        for k, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
            if s < e:
                shard = self._open(k)
                at = np.searchsorted(shard[0], keys[s:e])
                n[s:e], most[s:e] = shard[1][at], shard[2][at]
        return n, most


def judged(rows: DataFrame, listed: list[tuple[int, int, str]]) -> DataFrame:
    """``rows`` without ``pairs``, with ``n_best`` and ``count_sum``."""
    names = [c for c in rows.columns if c != "pairs"]
    at = rows.columns.index("pairs")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "pairs")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(listed)
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                best, sums = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                some = [k for k, v in enumerate(b.column(at)) if v.is_valid]
                if some:
                    pairs = [unpacked(b.column(at)[k].as_py()) for k in some]
                    owner = np.repeat(some, [len(p[0]) for p in pairs])
                    keys, back = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
                    n, most = (x[back] for x in shards.find(keys))
                    times = np.concatenate([p[1] for p in pairs])
                    np.add.at(best, owner, times * (n == most))
                    np.add.at(sums, owner, times * n)
                kept = [b.column(i) for i in range(b.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best), pa.array(sums)], names=[*names, "n_best", "count_sum"])

    return rows.mapInArrow(judge, f"{kinds}, n_best long, count_sum long")


def align(docs: DataFrame, *, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for each row of (doc_id, text)."""
    rows = cut(encoded(docs, first, second))
    listed = write_shards(cut(partial_counts(rows)), f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}")
    return judged(rows, listed)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
