"""Vectorised hashing of words and shingles over whole batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
PIECE = 1 << 18  # bytes that are hashed at once
SLICE = 1 << 20  # bytes of texts that an operator works on at once
_CACHED = 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least ``n`` of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, PIECE + 4096), np.uint64)
        have[1:] = base
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of codes[start:end] for each span, by one running sum over all codes."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=total[1:])
    value = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _pieces(data: bytes) -> list[bytes]:
    """A long text in pieces that end at white space."""
    if len(data) <= PIECE:
        return [data]
    out, at = [], 0
    while len(data) - at > PIECE:
        end = max(data.rfind(bytes([c]), at, at + PIECE) for c in SPACES)
        if end <= at:
            later = [p for c in SPACES if (p := data.find(bytes([c]), at + PIECE)) >= 0]
            end = min(later) if later else len(data)
        out.append(data[at:end])
        at = end
    return [*out, data[at:]]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and where each text's begin, with the end."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, owner, size
        if not group:
            return
        codes = np.frombuffer(b"\n" + b"\n".join(group).lower() + b"\n", np.uint8)
        edge = np.diff(IS_SPACE[codes].view(np.int8))
        starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        hashes.append(span_hashes(codes, starts, ends))
        begin = np.cumsum([1, *[len(g) + 1 for g in group]])
        np.add.at(counts, owner, np.diff(np.searchsorted(starts, begin)))
        group, owner, size = [], [], 0

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if size + len(piece) > PIECE:
                flush()
            group.append(piece)
            owner.append(i)
            size += len(piece)
    flush()
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most some ``SLICE`` bytes of a text column, one row at least; what a batch needs besides follows its bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    end = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles; a shorter text is one shingle."""
    words, at = word_hashes(texts)
    out = []
    rolled = words.copy()
    for k in range(1, width):
        m = len(words) - k
        if m <= 0:
            break
        rolled[:m] = mix64(rolled[:m] * np.uint64(0xA0761D6478BD642F) + words[k:])
    for i in range(len(texts)):
        n = int(at[i + 1] - at[i])
        if n == 0:
            out.append(np.empty(0, np.uint64))
        elif n < width:
            h = words[at[i] : at[i] + 1].copy()
            for k in range(1, n):
                h = mix64(h * np.uint64(0xA0761D6478BD642F) + words[at[i] + k])
            out.append(mix64(h + np.uint64(n)))
        else:
            s = np.sort(rolled[at[i] : at[i + 1] - width + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[list(SPACES)] = 32
_IN_WORD = ~IS_SPACE
_RUN_OF_SPACE = re.compile(rb"[\x09-\x0D\x20]+")


def normal_line(line: bytes) -> bytes:
    """A-Z lower-cased, runs of white space one space, none at the ends."""
    return _RUN_OF_SPACE.sub(b" ", line).strip(b" ").lower()


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of adjacent (row, number of its first line, start, end), of whole lines, of at most ``PIECE`` bytes or one line."""
    group: list[tuple[int, int, int, int]] = []
    size = 0
    for row in range(len(offsets) - 1):
        low, high = int(offsets[row]), int(offsets[row + 1])
        if size + high - low > PIECE and group:
            yield group
            group, size = [], 0
        if high - low <= PIECE:
            group.append((row, 0, low, high))
            size += high - low
            continue
        text, at, number = data[low:high].tobytes(), 0, 0
        while at <= len(text):
            end = len(text) if len(text) - at <= PIECE else text.rfind(b"\n", at, at + PIECE)
            if end < 0:
                end = text.find(b"\n", at + PIECE)
                end = len(text) if end < 0 else end
            yield [(row, number, low + at, low + end)]
            number += text.count(b"\n", at, end) + 1
            at = end + 1
    if group:
        yield group


def line_spans(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, line, codes, start, end), piece by piece: the lines that are not blank, in normal form, as spans of a piece's codes.

    Lines are numbered from 0 within their text; null texts have none.
    """
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, body = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    for group in _segments(data, offsets):
        low, high = group[0][2], group[-1][3]
        if high == low:
            continue
        if high - low > PIECE:  # one long line
            line = np.frombuffer(normal_line(data[low:high].tobytes()), np.uint8)
            if len(line):
                yield np.array([group[0][0]]), np.array([group[0][1]]), line, np.zeros(1, np.int64), np.array([len(line)])
            continue
        raw = data[low:high]
        row, number, begin, end = (np.array(x, np.int64) for x in zip(*group))
        begin, end = begin - low, end - low
        feeds = np.flatnonzero(raw == 10)
        lines = 1 + np.searchsorted(feeds, end) - np.searchsorted(feeds, begin)
        first = np.cumsum(lines) - lines
        inner = np.ones(int(lines.sum()), bool)
        inner[first] = False
        starts, ends = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
        starts[first], starts[inner] = begin, feeds + 1
        last = np.ones(len(inner), bool)
        last[first + lines - 1] = False
        ends[first + lines - 1], ends[last] = end, feeds
        keep = _IN_WORD[raw]
        after = np.concatenate([[False], keep[:-1]])
        after[starts[starts < len(raw)]] = False
        keep |= after  # the first space after a word
        codes = _LOWER[raw[keep]]
        where = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)]).astype(np.int64)
        starts, ends = where[starts], where[ends]
        trailing = (ends > starts) & (codes[np.maximum(ends, 1) - 1] == 32) if len(codes) else np.zeros(len(ends), bool)
        ends = ends - trailing
        full = ends > starts
        numbers = np.arange(len(inner)) - np.repeat(first - number, lines)
        yield np.repeat(row, lines)[full], numbers[full], codes, starts[full], ends[full]


def line_digests(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests (n, 2) of spans, as signed integers."""
    view = memoryview(np.ascontiguousarray(codes))
    made = b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(made, "<i8").reshape(-1, 2)


def _characters(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the spans in them."""
    if not len(part) or part.max() < 128:
        return part, starts, ends
    raw = part.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:  # spans by themselves, what is no UTF-8 replaced
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends)]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), ends - [len(t) for t in texts], ends
    index = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)]).astype(np.int64)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), index[starts], index[ends]


def char_shingles(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owners, counts, hashes) of the ``width``-character shingles of UTF-8 spans that ascend, in groups that fit a processor's cache.

    Of the hashes, the first counts[0] belong to span owners[0] and so on; those of owner
    len(starts) belong to none.  A shorter span is one shingle.
    """
    owner, low, high = [], [], []
    long = ends - starts > _CACHED
    for i in np.flatnonzero(long).tolist():  # in parts that overlap by width - 1 characters
        at, end = int(starts[i]), int(ends[i])
        while True:
            stop = min(end, at + _CACHED)
            while stop < end and codes[stop] & 0xC0 == 0x80:
                stop += 1
            far, count = stop, 0
            while far < end and count < width - 1:
                far += 1
                while far < end and codes[far] & 0xC0 == 0x80:
                    far += 1
                count += 1
            owner.append(i)
            low.append(at)
            high.append(far)
            if far == end:
                break
            at = stop
    short = np.flatnonzero(~long)
    none = len(starts)
    for who, a, b in ((short, starts[short], ends[short]), (np.array(owner, np.int64), np.array(low, np.int64), np.array(high, np.int64))):
        total = np.cumsum(b - a)
        s = 0
        while s < len(who):
            e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + _CACHED, "right")))
            base = int(a[s])
            chars, begin, end = _characters(codes[base : int(b[s:e].max())], a[s:e] - base, b[s:e] - base)
            n = len(chars)
            sums = np.zeros(n + 1, np.uint64)
            np.multiply(chars, _power(_BASE, n)[:n], out=sums[1:])
            np.cumsum(sums[1:], out=sums[1:])
            size = end - begin
            full = size >= width
            if n >= width:
                h = sums[width:] - sums[:-width]
                h *= _power(_INVERSE, n)[: n - width + 1]
                h += np.uint64(width * 0xD1342543DE82EF95 % (1 << 64))
                own = size[full] - width + 1
                # between the shingles of two spans stand those that reach over the end of one
                gap = np.diff(np.append(begin[full], n - width + 1)) - own
                owners = np.empty(2 * len(own) + 1, np.int64)
                counts = np.empty(len(owners), np.int64)
                owners[0::2], counts[0] = none, begin[full][0] if len(own) else n - width + 1
                owners[1::2], counts[1::2], counts[2::2] = who[s:e][full], own, gap
                if len(own):
                    counts[-1] = n - width + 1 - counts[:-1].sum()
                yield owners, counts, mix64(h)
            tiny = ~full
            if tiny.any():
                value = (sums[end[tiny]] - sums[begin[tiny]]) * _power(_INVERSE, n + 1)[begin[tiny]]
                yield who[s:e][tiny], np.ones(int(tiny.sum()), np.int64), mix64(value + size[tiny].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            s = e
