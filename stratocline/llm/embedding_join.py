"""Near-duplicate vectors by a pigeonhole join over subspaces.

Vectors of cosine ``c`` or more lie, at unit length, within the squared distance ``2 - 2c``.  A fixed random rotation
spreads any vector's length over all axes, which are then split into blocks of ``WIDTH``.  If every block of a pair exceeded its
share of that squared distance, in proportion to its axes, so would the sum: so each pair wanted is
within its share in some block.  Each block is a range join by its own: cells as wide as the radius on its first
axis, each compared with itself and its neighbours; inside a cell both sides are
sorted by the second axis, and windows of it are compared in the whole block by matrix products.  What is within a block's share is
verified on the vectors as given, in double precision.  A pair counts in the first block that finds it.

No link is lost: shares are compared with a slack far above the rounding of either precision, and blocks that say which of them
finds a pair first see the same digits.  Boxes in which many pairs are within a share are decided by products in double precision,
but for pairs too close to a threshold for that, which are verified one by one.

Scale: equal vectors are one node with a count.  Nodes are packed, ``PART`` to a row, and each two such rows meet once, in a
Cartesian product of the written table with itself: nothing is copied for a comparison and nothing of it is shuffled, so disk grows with the
input.  A row of that product is a tile of ``PART`` by ``PART`` nodes for all blocks and cells, whatever is dense in it; a task goes through the
tiles of two runs of rows and returns sums by node (so a node has at most two for each run) and the edges of a spanning forest, never pairs.
How much the blocks can leave out depends on the data: for directions without any structure in 64 dimensions the first axes tell little
apart, most pairs of a block are compared (in 16 of 64 dimensions, 3 pairs in a million go on), and the work grows with the square of the number of
different vectors, as README states.

Edges: null vectors, those without components or of length zero, or with null or non-finite components, link with nothing.
Vectors of different lengths (numbers of components) are never linked.  Repeated ids are rows of their own, the one id standing for all; rows with
a null id link others but name no component: they have the component's smallest id, null if there is none, and are kept only in a component without ids.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import cut, discard, table
from stratocline.llm.linking import components

WIDTH = 16  # axes of a block
PART = 8192  # nodes of one packed row at most
PART_BYTES = 16 << 20  # of their vectors
RUNS = 16  # runs of packed rows, each two of which are a task
RUN_BYTES = 128 << 20  # of a run's vectors on average, if that takes more runs
ROWS, COLUMNS = 256, 1024  # of a matrix product
SLACK = 1e-5  # beyond a block's share, for single precision
TINY = 1e-9  # beyond a threshold, for products in double precision
AT_ONCE = 16_384  # pairs verified in one call
EDGES = 1_000_000  # that a task holds before it leaves out what is connected already
_SEED = 20_240_611
_PARTS = pa.schema([("part", pa.int64()), ("size", pa.int32()), ("nodes", pa.binary()), ("copies", pa.binary()), ("raw", pa.binary())])


class Part(NamedTuple):
    """Nodes of a packed row: their numbers and copies, vectors as given, at length 1, and rotated."""

    node: np.ndarray
    copies: np.ndarray
    given: np.ndarray
    unit: np.ndarray
    turned: np.ndarray


def decoded(raw: bytes | pa.Buffer, count: int, size: int) -> np.ndarray:
    """Vectors (count, size) of doubles from little-endian bytes of either precision."""
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * count * size else "<f8").reshape(count, size).astype(float)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by a fixed rotation: twice random signs and a Hadamard transform, over a power of two of axes.

    Each row's digits are the same whatever rows it comes with.
    """
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(_SEED)
    for _ in range(2):
        y *= rng.choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            z = y.reshape(len(y), size // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), size)
            h *= 2
    return y / size


def spans(size: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """The blocks of axes of rotated vectors."""
    axes = 1 << max(0, size - 1).bit_length()
    return [(a, min(a + width, axes)) for a in range(0, axes, width)]


def shares(size: int, cosine: float, width: int = WIDTH) -> np.ndarray:
    """Each block's share of the squared distance."""
    blocks = spans(size, width)
    return np.array([(b - a) / blocks[-1][1] for a, b in blocks]) * (2 - 2 * cosine)


def block_distances(x: np.ndarray, y: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Squared distances (pairs, blocks) of rotated vectors."""
    d = (x - y) ** 2
    return np.stack([np.ascontiguousarray(d[:, a:b]).sum(1) for a, b in spans(x.shape[1], width)], 1)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows in double precision."""
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def radius(most: float) -> float:
    """What two rows within the squared distance ``most`` differ by on one axis, at most."""
    return float(np.sqrt(most + SLACK) + SLACK)


def near_boxes(x: np.ndarray, y: np.ndarray, most: float) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Boxes of rows of two sides, sorted by their second axis, with some pair within the squared distance ``most``, and which are."""
    at, limit, reach = min(1, x.shape[1] - 1), np.float32(most + SLACK), radius(most)
    a, b = (np.ascontiguousarray(v, np.float32) for v in (x, y))
    # |a - b|^2 as one product: both sides bring the squared length of the other kind of row
    aa, bb = (a * a).sum(1, keepdims=True), (b * b).sum(1, keepdims=True)
    a, b = np.hstack([-2 * a, aa, np.ones_like(aa)]), np.hstack([b, np.ones_like(bb), bb])
    low, high = np.searchsorted(y[:, at], x[:, at] - reach, "left"), np.searchsorted(y[:, at], x[:, at] + reach, "right")
    for s in range(0, len(x), ROWS):
        e = min(s + ROWS, len(x))
        for c in range(low[s], high[e - 1], COLUMNS):
            d = min(c + COLUMNS, high[e - 1])
            near = a[s:e] @ b[c:d].T <= limit
            if near.any():
                yield slice(s, e), slice(c, d), near


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that connect what the pairs of nodes connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (label[x], label[y], x, y):
            np.minimum.at(new, side, m)
        while True:  # labels point to smaller ones, down to a root
            root = new[new]
            if (root == new).all():
                break
            new = root
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def single(x: np.ndarray) -> bytes:
    """Bytes of doubles, in single precision if that says all."""
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype("<f4")
    return (short if (short == x).all() else x).tobytes()


def encoded(vectors: DataFrame) -> DataFrame:
    """(vec_id, hi, lo, size, raw) of each row: the vector's bytes and the digest of it as doubles; nulls for vectors that link with nothing."""
    kind = dict(vectors.dtypes)["vec_id"]
    names = ["vec_id", "hi", "lo", "size", "raw"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for v in b.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    rows.append((None,) * 4)
                    continue
                x = x + 0.0  # one zero
                d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), len(x), single(x)))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return vectors.select("vec_id", "embedding").mapInArrow(build, f"vec_id {kind}, hi long, lo long, size int, raw binary")


def packed(nodes: DataFrame) -> DataFrame:
    """Rows of ``_PARTS`` from rows (node, size, copies, raw): vectors of one length, up to ``PART`` of them; the first node names the part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, int, bytes]]] = {}
        total = 0

        def done(kind: tuple[int, int]) -> pa.RecordBatch:
            node, copies, raw = zip(*held.pop(kind))
            row = ([node[0]], [kind[0]], *([np.array(v, np.int64).tobytes()] for v in (node, copies)), [b"".join(raw)])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _PARTS)], schema=_PARTS)

        for b in batches:
            for node, size, copies, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                kind = (size, len(raw))
                held.setdefault(kind, []).append((node, copies, raw))
                total += len(raw)
                if len(held[kind]) == PART or (len(held[kind]) + 1) * len(raw) > PART_BYTES:
                    total -= len(held[kind]) * len(raw)
                    yield done(kind)
                elif total > 4 * PART_BYTES:  # of many lengths
                    yield from map(done, list(held))
                    total = 0
        yield from map(done, list(held))

    return nodes.select("node", "size", "copies", "raw").mapInArrow(pack, "part long, size int, nodes binary, copies binary, raw binary")


def tiles(parts: DataFrame, runs: int) -> DataFrame:
    """Each two rows of ``_PARTS`` with vectors of one length once, and each row with itself, by runs against runs."""
    sides = [parts.coalesce(runs).select(*(F.col(c).alias(f"{side}_{c}") for c in _PARTS.names)) for side in "xy"]
    return sides[0].join(sides[1].hint("shuffle_replicate_nl"), (F.col("x_size") == F.col("y_size")) & (F.col("x_part") <= F.col("y_part")))


def pairs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is true, much sooner than ``nonzero`` where little is."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of places after the pairs are connected: each label is the smallest place of its component."""
    u, v = label[i], label[j]
    apart = u != v
    if not apart.any():
        return label
    to = np.arange(len(label))
    u, v = forest(u[apart], v[apart])
    to[u] = v
    return to[label]


def by_products(x: Part, y: Part, p: np.ndarray, q: np.ndarray, block: int, cosine: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows p of x and q of y: which pairs are links that ``block`` finds first, and which are too close to a threshold to say."""
    blocks, share = spans(x.given.shape[1], width), shares(x.given.shape[1], cosine, width) + SLACK / 2
    good, doubt = np.ones((2, len(p), len(q)), bool)
    doubt[:] = False
    for k, (a, b) in enumerate(blocks[: block + 1]):
        u, v = x.turned[p, a:b], y.turned[q, a:b]
        over = (u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * (u @ v.T) - share[k]
        doubt |= np.abs(over) < TINY
        good &= over > 0 if k < block else over <= 0
        if not good.any():
            return good, doubt
    over = x.unit[p] @ y.unit[q].T - cosine
    doubt |= np.abs(over) < TINY
    return good & (over >= 0) & ~doubt, doubt


def verified(x: Part, y: Part, i: np.ndarray, j: np.ndarray, block: int, cosine: float, width: int) -> np.ndarray:
    """Which pairs of rows are links that ``block`` finds first."""
    share = shares(x.given.shape[1], cosine, width) + SLACK / 2
    d = block_distances(x.turned[i], y.turned[j], width)
    good = (d[:, block] <= share[block]) & (d[:, :block] > share[:block]).all(1)
    own = np.flatnonzero(good)
    good[own] = cosines(x.given[i[own]], y.given[j[own]]) >= cosine
    return good


def compared(x: Part, y: Part, same: bool, cosine: float, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of x and of y with copies of the other side's nodes, and labels of rows of both by what the links connect; ``same``: of x with itself."""
    size, shift = x.given.shape[1], 0 if same else len(x.node)
    found_x = np.zeros(len(x.node), np.int64)
    found_y = found_x if same else np.zeros(len(y.node), np.int64)
    label = np.arange(shift + len(y.node))
    wait: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(block: int) -> None:
        nonlocal label
        pairs = [np.concatenate(v) for v in zip(*wait)]
        wait.clear()
        for s in range(0, len(pairs[0]) if pairs else 0, AT_ONCE):
            i, j = (v[s : s + AT_ONCE] for v in pairs)
            good = verified(x, y, i, j, block, cosine, width)
            i, j = i[good], j[good]
            np.add.at(found_x, i, y.copies[j])
            np.add.at(found_y, j, x.copies[i])
            label = merged(label, i, j + shift)

    for k, ((a, b), share) in enumerate(zip(spans(size, width), shares(size, cosine, width))):
        sides = []
        for v in (x.turned, y.turned):
            cell = np.floor(v[:, a] / radius(share)).astype(np.int64)
            order = np.lexsort((v[:, min(a + 1, b - 1)], cell))
            sides.append((order, cell[order]))
        (order_x, cell_x), (order_y, cell_y) = sides
        for cell in np.unique(cell_x):
            own = order_x[slice(*np.searchsorted(cell_x, [cell, cell + 1]))]
            for step in (0, 1) if same else (-1, 0, 1):
                other = order_y[slice(*np.searchsorted(cell_y, [cell + step, cell + step + 1]))]
                for rows, columns, near in near_boxes(x.turned[own, a:b], y.turned[other, a:b], share):
                    p, q = own[rows], other[columns]
                    if same and step == 0:
                        near &= x.node[p][:, None] < y.node[q]
                    if np.count_nonzero(near) > max(64, near.size // 128):
                        good, doubt = by_products(x, y, p, q, k, cosine, width)
                        good, near = good & near, doubt & near
                        if good.any():
                            found_x[p] += good @ y.copies[q]
                            found_y[q] += x.copies[p] @ good
                            i, j = pairs_of(good & (label[p][:, None] != label[q + shift]))
                            label = merged(label, p[i], q[j] + shift)
                    i, j = pairs_of(near)
                    if len(i):
                        wait.append((p[i], q[j]))
                        if sum(len(v) for v, _ in wait) >= AT_ONCE:
                            settle(k)
        settle(k)
    return found_x, found_y, label


def linked(rows: DataFrame, cosine: float, width: int = WIDTH) -> DataFrame:
    """(node, n, other): links of a node with the copies of others (other null), and edges of spanning forests (n null), from rows of ``tiles``, task by task."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by part
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        turns: dict[int, np.ndarray] = {}  # the rotation by length
        last: tuple[int | None, Part | None] = (None, None)

        def opened(size: int, *held: pa.BinaryScalar) -> Part:
            nodes, copies, raw = (v.as_buffer() for v in held)
            node, copies = np.frombuffer(nodes, np.int64), np.frombuffer(copies, np.int64)
            given = decoded(raw, len(node), size)
            unit = units(given)
            if size not in turns:
                turns[size] = rotated(np.eye(size))
            return Part(node, copies, given, unit, unit @ turns[size])

        def fewer() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate(e) for e in zip(*edges)))

        for b in batches:
            for x_part, size, *x_held, y_part, _, y_nodes, y_copies, y_raw in zip(*b.columns):
                x_part, y_part, size = x_part.as_py(), y_part.as_py(), size.as_py()
                if last[0] != x_part:  # a row meets all others of a run one after the other
                    last = (x_part, opened(size, *x_held))
                x = last[1]
                y = x if x_part == y_part else opened(size, y_nodes, y_copies, y_raw)
                found_x, found_y, label = compared(x, y, x is y, cosine, width)
                for part, side, found in ((x_part, x, found_x), (y_part, y, found_y))[: 1 if x is y else 2]:
                    node, n = tally.setdefault(part, (np.array(side.node), np.zeros(len(side.node), np.int64)))
                    n += found
                nodes = x.node if x is y else np.concatenate([x.node, y.node])
                other = np.flatnonzero(label != np.arange(len(label)))
                edges.append((nodes[other], nodes[label[other]]))
                if sum(len(e) for e, _ in edges) > EDGES:
                    edges = [fewer()]
        for node, n in tally.values():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.nulls(len(some), pa.int64())], schema=schema)
        if edges:
            u, v = fewer()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(v)], schema=schema)

    return rows.mapInArrow(join, "node long, n long, other long")


def near_vectors(vectors: DataFrame, *, cosine: float = 0.9, width: int = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding)."""
    rows = encoded(vectors)  # written nowhere: made again for the result
    alike = rows.where(F.col("hi").isNotNull()).groupBy("hi", "lo").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("raw").alias("raw"))
    nodes = cut(alike.select(F.monotonically_increasing_id().alias("node"), "*"))
    count, axes = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    full = max(1, -(-count // PART), -(-8 * axes // PART_BYTES))  # packed rows
    runs = max(min(full, RUNS), -(-8 * axes // RUN_BYTES))
    parts = cut(packed(nodes).repartition(runs))
    found = cut(linked(tiles(parts, runs), cosine, width))
    discard(parts)
    comps = components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.where(F.col("n").isNotNull()).groupBy(F.col("node").alias("l_node")).agg(F.sum("n").alias("links"))
    known = nodes.drop("raw").join(links, F.col("node") == F.col("l_node"), "left").join(comps.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    known = cut(known.select(F.col("hi").alias("k_hi"), F.col("lo").alias("k_lo"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")))
    for old in (nodes, found):
        discard(old)
    known = known.join(known.groupBy(F.col("comp").alias("m_comp")).agg(F.min("first").alias("component")), F.col("comp") == F.col("m_comp"))
    out = rows.drop("raw").join(known.select("k_hi", "k_lo", "n_links", "component"), (F.col("hi") == F.col("k_hi")) & (F.col("lo") == F.col("k_lo")), "left")
    component = F.when(F.col("hi").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP12_SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS MATERIALIZED (
  SELECT vec_id, x FROM v
  WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, k.c AS component_id, v.vec_id = k.c AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) k ON k.vec_id = v.vec_id
"""
