"""Edit-aware token counts.

A document is split into pre-tokens by the tokenizer's pattern; merges never cross a
pre-token, so its count is the sum over its pre-tokens.  The counts stand in the
leaves of a segment tree, ``LEAF`` pre-tokens each, with subtree sums of characters
and of tokens.  An edit of a character span finds the touched leaves by descending
over the character sums, splits anew only those with some characters of context on
both sides until the old boundaries are met again, encodes only pre-tokens
that are new there, replaces the leaves and updates the sums on their paths.

Scale: documents are counted where they lie, without a shuffle; edits come as an
array column of the same row (join them by id before, where they come as a table).
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 32  # pre-tokens in a leaf when it is built
CONTEXT = 2  # characters beyond an edit that can change where a pre-token ends
CACHE = 400_000  # pre-tokens whose counts a task remembers


class Counter:
    """Splits and counts with a byte-level BPE given by a file of ranks."""

    def __init__(self, ranks: str = RANKS, pattern: str = PATTERN) -> None:
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = list(map(known.get, pieces))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    p = pieces[i]
                    if (n := known.get(p)) is None:
                        n = len(self.encoding.encode_ordinary(p))
                        if len(p) <= 64:
                            known[p] = n
                    out[i] = n
        self.encoded += len(pieces)
        return out


class TokenTree:
    """A segment tree over the pre-tokens of one text."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        pieces = counter.split(text)
        counts = counter.count(pieces)
        cuts = range(0, len(pieces), LEAF) or (0,)
        self.leaves = [pieces[i : i + LEAF] for i in cuts]
        self.counts = [counts[i : i + LEAF] for i in cuts]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = self._sums(list(map(len, pieces)), cuts)
        self.tokens = self._sums(counts, cuts)

    def _sums(self, values: list[int], cuts) -> list[int]:
        """The nodes of a tree over the leaves' sums: node i has the children 2i and 2i + 1."""
        tree = np.zeros(2 * self.size, np.int64)
        if values:
            tree[self.size : self.size + len(cuts)] = np.add.reduceat(np.array(values, np.int64), np.array(cuts))
        width = self.size
        while width > 1:
            tree[width // 2 : width] = tree[width : 2 * width : 2] + tree[width + 1 : 2 * width : 2]
            width //= 2
        return tree.tolist()

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(p) for p in self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf with characters beyond the end), and where it begins."""
        node, begin = 1, 0
        at = min(at, max(0, self.length - 1))
        while node < self.size:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters ``start`` to ``stop`` (clipped to the text) by ``new``."""
        start = min(max(0, start), self.length)
        stop = min(max(start, stop), self.length)
        a, a_at = self._leaf(max(0, start - CONTEXT))
        b, b_at = self._leaf(min(stop + CONTEXT, max(0, self.length - 1)))
        while True:
            pieces = [p for leaf in self.leaves[a : b + 1] for p in leaf]
            ends, at = [], a_at
            for p in pieces:
                at += len(p)
                ends.append(at)
            old = "".join(pieces)
            left_open, right_open = a > 0, b + 1 < len(self.leaves) and self.chars[1] > at
            # one leaf more on each side tells whether the split meets the old boundaries again
            before = self._next(a, -1) if left_open else None
            after = self._next(b, 1) if right_open else None
            lead = "".join(self.leaves[before]) if before is not None else ""
            trail = "".join(self.leaves[after]) if after is not None else ""
            fresh = self.counter.split(lead + old[: start - a_at] + new + old[stop - a_at :] + trail)
            size = len(lead) + len(old) - (stop - start) + len(new)
            bounds, at = [0], 0
            for p in fresh:
                at += len(p)
                bounds.append(at)
            i, j = bisect.bisect_left(bounds, len(lead)), bisect.bisect_left(bounds, size)
            good_left = before is None or bounds[i] == len(lead)
            good_right = after is None or bounds[j] == size
            # the pieces of the context must be those that stood there
            good_left = good_left and (before is None or fresh[:i] == self.leaves[before])
            good_right = good_right and (after is None or fresh[j:][:-1] == self.leaves[after][: len(fresh) - j][:-1])
            if good_left and good_right:
                self._replace(a, b, fresh[i:j])
                return
            if not good_left:
                a = before
                a_at -= len(lead)
            if not good_right:
                b = after

    def _next(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    def _replace(self, a: int, b: int, pieces: list[str]) -> None:
        """Deals the pieces over leaves a to b, keeping the counts of pieces that stood there, and updates the sums above."""
        known = {p: n for leaf in range(a, b + 1) for p, n in zip(self.leaves[leaf], self.counts[leaf])}
        missing = [p for p in dict.fromkeys(pieces) if p not in known]
        known.update(zip(missing, self.counter.count(missing)))
        share = -(-len(pieces) // (b - a + 1)) if pieces else 0
        for k, leaf in enumerate(range(a, b + 1)):
            part = pieces[k * share : (k + 1) * share]
            self.leaves[leaf], self.counts[leaf] = part, [known[p] for p in part]
            self.chars[self.size + leaf], self.tokens[self.size + leaf] = sum(map(len, part)), sum(self.counts[leaf])
        lo, hi = (self.size + a) // 2, (self.size + b) // 2
        while lo:
            for i in range(lo, hi + 1):
                self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            lo, hi = lo // 2, hi // 2


COUNTS = "n_pretokens long, n_tokens long, n_edits int, reencoded_pretokens long, n_chars_after long, n_tokens_after long"


def count_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, counts before and after the edits) for each row.

    ``edits``: array<struct<start:int, stop:int, new:string>>, applied in order, each to
    the text that the one before left; spans are clipped to the text; null edits
    and null fields change nothing.  Null texts count as empty; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    none = F.array().cast("array<struct<start:int,stop:int,new:string>>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for b in batches:
            rows: list[list[int]] = []
            for text, changes in zip(b.column(1), b.column(2).to_pylist()):
                tree = TokenTree(text.as_py() or "", counter)
                n, before = sum(map(len, tree.leaves)), tree.total
                counter.encoded = applied = 0
                for e in changes or ():
                    if e and None not in e.values():
                        tree.edit(e["start"], e["stop"], e["new"])
                        applied += 1
                rows.append([n, before, applied, counter.encoded, tree.length, tree.total])
            columns = [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int32() if i == 2 else pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *[c.split()[0] for c in COUNTS.split(", ")]])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (none if edits is None else edits).alias("edits")).mapInArrow(count, f"doc_id {kind}, {COUNTS}")


def sample_edits(text: Column) -> Column:
    """Three edits that follow from the text's length: a word put in the middle, a span cut out after a third, a new end."""
    n = F.coalesce(F.length(text), F.lit(0))

    def edit(start, stop, new):
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(new).alias("new"))

    middle, third = F.floor(n / 2), F.floor(n / 3)
    return F.array(edit(middle, middle, " revised"), edit(third, third + 24, ""), edit(n, n + 8, "\nEnd of the edited text."))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_with_edits(docs, edits=sample_edits(F.col("text")))
