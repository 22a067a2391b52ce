"""Linking near-duplicates: banding, verified links, connected components. All distributed.

Nodes are 64-bit numbers of distinct contents (exact copies are one node).  Each node
brings one 64-bit key per band; nodes that share a key are in one bucket.

A bucket gets a pivot and each other member is compared with it; members that this
connects need no more comparison, since only components count.  So a large group of
near copies costs about one comparison a member and band.  What is still in different
components of a bucket is then compared pair by pair, in buckets of more than ``SMALL``
members in blocks: the members of the bucket's largest
component are dealt over parts of at most ``BLOCK`` and need no comparison with each
other; only the strays outside it go to every part.  What a pair is rejected by travels
with the members, and only pairs that may be links leave a block.  So no link is lost
and no pair is made that is not compared.

Bucket entries cross the shuffle packed, 12 bytes each, by ranges of keys; a range
holds some ``RANGE`` entries whatever the size of the input.  Before that each task
links the members of a bucket that it holds itself and sends on one of them, so that a
bucket with a third of all rows meets as one entry per task and batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocline.llm.common import cut, discard
from stratocline.llm.hashing import mix64

PACKED = "part int, heads binary, near binary"
MEMBERS = "key long, node long, pivot long"
RANGE = 1 << 18  # entries that a range of keys holds on average
SMALL = 8  # members of a bucket whose pairs are listed one by one
BLOCK = 1024  # members of a bucket's largest component in one block, and twice the strays
PAIRS_AT_ONCE = 40_000  # pairs that are compared in one call
HELD_BYTES = 4 << 20  # payloads of blocks that wait to be compared together
_HEAD = np.dtype([("key", "<u4"), ("node", "<i8")])
_NEAR = np.dtype([("key", "<i8"), ("node", "<i8"), ("near", "<i8")])
_PACKED = pa.schema([("part", pa.int32()), ("heads", pa.binary()), ("near", pa.binary())])
_MEMBERS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("pivot", pa.int64())])

Step = Callable[[DataFrame], DataFrame]
#: Of the members' payloads, two arrays of their numbers and the keys of the pairs' buckets: which pairs may be links.
Compare = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def ranges(entries: int) -> int:
    """How many ranges the keys of so many bucket entries are dealt to."""
    return max(16, -(-entries // RANGE))


def bucket_key(key: np.ndarray, parts: int) -> np.ndarray:
    """The range of each 64-bit key, in the upper half, and its lower half."""
    part = (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return ((part << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))).view(np.int64)


def _runs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of keys with two nodes or more, once each and in the order of their keys, with their bucket's pivot: the key picks it."""
    order = np.lexsort((node, mix64(node.view(np.uint64) ^ key.view(np.uint64)), key))
    key, node = key[order], node[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])[: len(key)]
    key, node = key[fresh], node[fresh]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    size = np.diff(np.append(first, len(key)))
    keep = np.repeat(size > 1, size)
    return key[keep], node[keep], np.repeat(node[first], size)[keep]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Places of the keys that occur more than once."""
    seen = np.sort(key)
    often = seen[1:][seen[1:] == seen[:-1]]
    if not len(often):
        return np.empty(0, np.int64)
    low = np.zeros(1 << 20, bool)  # most keys are told apart by their last bits
    low[often & 0xFFFFF] = True
    at = np.flatnonzero(low[key & 0xFFFFF])
    return at[often[np.minimum(np.searchsorted(often, key[at]), len(often) - 1)] == key[at]]


def packed(node: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` for nodes and their keys (n, bands): of each bucket in them one node goes on, the others are near it."""
    bands = keys.shape[1]
    for s in range(0, len(node), 8192):
        key = bucket_key(keys[s : s + 8192].T.ravel(), parts)
        own = np.tile(node[s : s + 8192], bands)
        order = np.argsort(key)
        key, own = key[order], own[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        many = np.flatnonzero(~(new & np.append(new[1:], True)))
        k, n, pivot = _runs(key[many], own[many])
        other = n != pivot
        near = np.empty(int(other.sum()), _NEAR)
        near["key"], near["node"], near["near"] = k[other], n[other], pivot[other]
        key, own = key[new], own[new]
        # the pivot stands for its bucket
        own[np.searchsorted(key, k[~other])] = pivot[~other]
        head = np.empty(len(key), _HEAD)
        head["key"], head["node"] = key & 0xFFFFFFFF, own
        part = key >> 32
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        body = [head[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(head)))]
        # what is linked already goes anywhere
        lumps = [near[a : a + 4096].tobytes() for a in range(0, len(near), 4096)]
        where = np.concatenate([part[edge], (int(own[0]) + 7919 * np.arange(len(lumps))) % parts]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array([*body, *[b""] * len(lumps)], pa.binary()), pa.array([*[b""] * len(body), *lumps], pa.binary())], schema=_PACKED)


def buckets(rows: DataFrame) -> DataFrame:
    """(key, node, pivot) of buckets with two members or more, from rows of ``PACKED``."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        name = None

        def done() -> Iterator[pa.RecordBatch]:
            entries = np.frombuffer(b"".join(held), _HEAD)
            held.clear()
            low = entries["key"].astype(np.int64)
            at = _repeated(low)
            if len(at):
                yield _batch(_MEMBERS, *_runs((np.int64(name) << 32) | low[at], entries["node"][at]))

        for b in batches:
            for part, heads, near in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if part != name:
                    yield from done()
                    name = part
                held.append(heads.as_py())
                if len(near.as_py()):
                    x = np.frombuffer(near.as_py(), _NEAR)
                    yield _batch(_MEMBERS, *(np.ascontiguousarray(x[c]) for c in ("key", "node", "near")))
        if name is not None:
            yield from done()

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, "part").sortWithinPartitions("part").mapInArrow(members, MEMBERS)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of the edges (a, b): comp is the smallest node that it is connected with.

    Alternating large and small stars; each keeps one edge per row and is written, so
    that a lost executor costs one step.  Groups are minima joined back, never lists.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(e)
        e = after
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, node, comp, ...) dealt into blocks: the same columns with ``stray``, ``part``, ``at`` and ``with``.

    Block (i, j) holds part i of the bucket's largest component and part j of its
    strays; (-1 - i, j) holds two parts of strays.
    """
    of = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    of = of.groupBy(F.col("key").alias("p_key")).agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"))
    of = of.select("p_key", F.col("most.comp").alias("most"), F.ceil(F.col("most.n") / F.lit(BLOCK)).cast("int").alias("giants"), F.ceil((F.col("n") - F.col("most.n")) / F.lit(max(1, BLOCK // 2))).cast("int").alias("strays"))
    dealt = rows.join(of, F.col("key") == F.col("p_key"))
    stray = F.col("comp") != F.col("most")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.when(stray, F.col("strays")).otherwise(F.col("giants"))).cast("int")
    dealt = dealt.withColumn("stray", stray).withColumn("part", part)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda at, other: F.struct(at.cast("int").alias("at"), other.cast("int").alias("with"))
    with_giants = F.transform(upto(F.col("giants")), lambda i: block(i, F.col("part")))
    with_strays = F.transform(F.filter(upto(F.col("strays")), lambda j: j != F.col("part")), lambda j: block(-1 - F.least(j, F.col("part")), F.greatest(j, F.col("part"))))
    places = F.when(F.col("stray"), F.concat(with_giants, with_strays)).otherwise(F.transform(upto(F.col("strays")), lambda j: block(F.col("part"), j)))
    return dealt.select(*rows.columns, "stray", "part", F.inline(places))


def block_pairs(rows: DataFrame, compare: Compare) -> DataFrame:
    """Pairs (a, b) that may be links, of members (key, node, comp, payload) of one bucket and different components.

    A task holds one block at a time: at most ``BLOCK`` members of the largest component and half as many strays on average.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = [[], [], [], [], [], 0, 0]  # left, right, key, node, payload of pairs still to compare, how many, and the payloads' bytes

        def compared() -> Iterator[pa.RecordBatch]:
            if waiting[5]:
                left, right, key, node = (np.concatenate(w) for w in waiting[:4])
                for s in range(0, len(left), PAIRS_AT_ONCE):
                    x, y = left[s : s + PAIRS_AT_ONCE], right[s : s + PAIRS_AT_ONCE]
                    good = compare(waiting[4], x, y, key[s : s + PAIRS_AT_ONCE])
                    x, y = node[x[good]], node[y[good]]
                    yield _batch(schema, np.minimum(x, y), np.maximum(x, y))
            waiting[:] = [[], [], [], [], [], 0, 0]

        def add(name: tuple[int, int, int], held: list) -> None:
            node, comp, stray = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2))
            giants, strays = np.flatnonzero(~stray), np.flatnonzero(stray)
            x, y = [np.repeat(giants, len(strays))], [np.tile(strays, len(giants))]
            if name[1] <= 0:  # once for each two parts of strays, and each part
                i, j = np.triu_indices(len(strays), 1)
                part = np.concatenate([h[4] for h in held])[strays]
                wanted = comp[strays[i]] != comp[strays[j]]
                if name[1] < 0:
                    wanted &= part[i] != part[j]
                x.append(strays[i[wanted]])
                y.append(strays[j[wanted]])
            x, y = np.concatenate(x), np.concatenate(y)
            if len(x):
                base = len(waiting[4])
                for w, value in zip(waiting, (x + base, y + base, np.full(len(x), name[0], np.int64), node)):
                    w.append(value)
                waiting[4].extend(p for h in held for p in h[3])
                waiting[5] += len(x)
                waiting[6] += sum(len(p) for h in held for p in h[3])

        held: list = []  # pieces of the block that is not complete yet
        name = None
        for b in batches:
            if not b.num_rows:
                continue
            names = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)], 1)
            node, comp, stray, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6))
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1), len(names)]
            for s, e in zip(edges[:-1], edges[1:]):
                if tuple(names[s]) != name and held:
                    add(name, held)
                    held = []
                    if waiting[5] >= PAIRS_AT_ONCE or waiting[6] >= HELD_BYTES:
                        yield from compared()
                name = tuple(names[s])
                held.append((node[s:e], comp[s:e], stray[s:e], b.column(7).slice(s, e - s).to_pylist(), part[s:e]))
        if held:
            add(name, held)
        yield from compared()

    placed = blocks(rows).repartition(spread, "key", "at", "with").sortWithinPartitions("key", "at", "with")
    return placed.select("key", "at", "with", "node", "comp", "stray", "part", "payload").mapInArrow(pairs, "a long, b long")


def small_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) in different components, of members (key, node, comp) of buckets with at most ``SMALL`` members."""
    listed = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "comp"))).alias("m"))
    pair = lambda x, y: F.struct(x["node"].alias("a"), y["node"].alias("b"), (x["comp"] != y["comp"]).alias("apart"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(SMALL)), lambda y: pair(x, y))))
    return listed.select(F.inline(pairs)).where("apart").select("a", "b").distinct()


def link(members: DataFrame, confirm: Step, payload: Step, compare: Compare, names: DataFrame | None = None) -> DataFrame:
    """(node, comp) of all nodes with a confirmed link, from the buckets (key, node, pivot), a written table.

    ``confirm`` takes distinct pairs (a, b) and returns those that are links;
    ``payload`` takes nodes (node) and returns (node, payload binary) for ``compare``.
    Where the buckets hold hashes that several nodes may share, ``names`` (name, node) tells them apart.
    """
    tried = members.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    if names is not None:
        side = [names.select(F.col("name").alias(f"name_{x}"), F.col("node").alias(f"node_{x}")) for x in "ab"]
        tried = tried.join(side[0], F.col("a") == F.col("name_a")).join(side[1], F.col("b") == F.col("name_b")).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    tried = cut(tried)
    comps = components(confirm(tried).select("a", "b"))
    if names is None:
        known = members.join(comps, "node", "left").select("key", "node", F.col("node").alias("name"), "pivot", F.coalesce("comp", "node").alias("comp"))
    else:
        placed = cut(names.join(comps, "node", "left").select("name", "node", F.coalesce("comp", "node").alias("comp")))
        known = members.withColumnRenamed("node", "m_name").join(placed, F.col("m_name") == F.col("name")).select("key", "node", "name", "pivot", "comp")
    # a bucket's only pivot has been compared with all others, and what it is linked with is one component
    rest = F.when(F.col("name") != F.col("pivot"), F.col("comp"))
    apart = known.groupBy(F.col("key").alias("a_key")).agg((F.min("pivot") == F.max("pivot")).alias("one"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.min(rest).alias("rest_least"), F.max(rest).alias("rest_most"))
    apart = apart.where(F.when(F.col("one"), F.col("rest_least") < F.col("rest_most")).otherwise(F.col("least") < F.col("most"))).select("a_key", "one")
    left = cut(known.join(apart, F.col("key") == F.col("a_key")).where(~F.col("one") | (F.col("name") != F.col("pivot"))).select("key", "node", "comp").distinct())
    sized = left.join(left.groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("size")), F.col("key") == F.col("s_key")).select("key", "node", "comp", "size")
    new = small_pairs(sized.where(F.col("size") <= SMALL).drop("size"))
    large = cut(sized.where(F.col("size") > SMALL).drop("size"))
    if not large.isEmpty():
        rows = large.join(payload(large.select("node").distinct()), "node").select("key", "node", "comp", "payload")
        new = new.unionByName(block_pairs(rows, compare)).distinct()
    new = cut(new.join(tried, ["a", "b"], "left_anti"))
    if new.isEmpty():
        return comps
    found = cut(confirm(new).select("a", "b"))
    for old in (tried, left, large, new):
        discard(old)
    # what is linked already is one node of the second run
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    named = cut(ends.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.col("comp").isNull().alias("alone")))
    side = [named.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}")) for x in "ab"]
    merged = components(found.join(side[0], "a").join(side[1], "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))).select(F.col("node").alias("m_node"), F.col("comp").alias("m_comp"))
    every = comps.unionByName(named.where("alone").select("node", "comp"))
    return every.join(merged, F.col("comp") == F.col("m_node"), "left").select("node", F.coalesce("m_comp", "comp").alias("comp"))


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys (n, bands) from registers (n, at least bands * rows), each band with hashes of its own."""
    key = np.broadcast_to((np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), (len(registers), bands)).copy()
    used = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0xA0761D6478BD642F) + used[:, :, r])
    return key


def first_shared(keys: np.ndarray, x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of pairs of rows of bucket ``keys`` in buckets ``key``: whether that is the first bucket that they share.

    All buckets of a pair in different components are compared, so each pair needs to be
    compared in one of them only.
    """
    return keys[x, (keys[x] == keys[y]).argmax(1)] == key


def shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of sorted arrays that are not empty: how many values of the second are in the first."""
    out = np.zeros(len(x), np.int64)
    order = np.argsort(x, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else ():
        a = sets[x[run[0]]]
        for s in range(0, len(run), 256):
            part = run[s : s + 256]
            others = [sets[j] for j in y[part]]
            values = np.concatenate(others)
            hit = a[np.minimum(np.searchsorted(a, values), len(a) - 1)] == values
            out[part] = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))
    return out
