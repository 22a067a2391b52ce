"""Nearest stations by adaptive squares: exact for clusters, deserts and ties, without a limit on stations.

A square over all stations and points is split into quarters until each leaf holds few of either; only leaf counts
come to the driver, and the bounds of a leaf grow with the tables, so that leaves stay below some ten thousand.  For a
leaf with points, the leaves whose far corners together hold ``k`` stations bound how far any of its points has to
look; stations of every leaf within that bound meet the points, by an equal join on the leaf.  Inside a group
distances are compared in chunks.  Equal distances go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_LEVEL, STEP, LAST_LEVEL = 6, 3, 24  # of halvings of the side: in the first pass, in each later one, at most
STATIONS, POINTS, LEAVES = 32, 2048, 8192  # of a leaf at least before it is split; leaves that larger tables aim at
CHUNK = 1 << 20  # distances held at once


def code_of(level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of a square: its level and place."""
    return (np.int64(level) << 52) | (x.astype(np.int64) << 26) | y.astype(np.int64)


@dataclass(frozen=True)
class Tree:
    """The leaves (codes in order) over a square, and the stations and points in each."""

    x: float
    y: float
    side: float
    codes: np.ndarray
    stations: np.ndarray
    points: np.ndarray

    def square(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cells = 1 << level
        i, j = (np.clip(np.floor((v - v0) / self.side * cells), 0, cells - 1) for v, v0 in ((x, self.x), (y, self.y)))
        return code_of(level, i, j)

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place of each coordinate's leaf in ``codes``."""
        out = np.full(len(x), -1, np.int64)
        for level in np.unique(self.codes >> 52):
            code = self.square(int(level), x, y)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out = np.where(self.codes[at] == code, at, out)
        return out

    def boxes(self) -> np.ndarray:
        """(leaves, 4): least and greatest x, least and greatest y."""
        size = self.side / 2.0 ** (self.codes >> 52)
        i, j = (self.codes >> 26) & 0x3FFFFFF, self.codes & 0x3FFFFFF
        return np.stack([self.x + i * size, self.x + (i + 1) * size, self.y + j * size, self.y + (j + 1) * size], 1)

    def needed(self, leaf: int, k: int) -> np.ndarray:
        """The leaves that may hold one of the ``k`` nearest stations of any point in ``leaf``."""
        box, some = self.boxes(), np.flatnonzero(self.stations)
        own, other = box[leaf], box[some]
        gap = [np.maximum(0, np.maximum(other[:, a] - own[a + 1], own[a] - other[:, a + 1])) for a in (0, 2)]
        far = [np.maximum(np.abs(other[:, a + 1] - own[a]), np.abs(own[a + 1] - other[:, a])) for a in (0, 2)]
        near, most = np.hypot(*gap), np.hypot(*far)
        order = np.argsort(most)
        enough = np.searchsorted(np.cumsum(self.stations[some][order]), k)
        bound = most[order[min(enough, len(order) - 1)]] if len(order) else 0.0
        return some[near <= bound * (1 + 1e-9)] if enough < len(order) else some


def tree(points: DataFrame, stations: DataFrame) -> Tree:
    """Leaves over points and stations (x, y); counts only come to the driver."""
    both = stations.select("x", "y", F.lit(True).alias("s")).unionByName(points.select("x", "y", F.lit(False).alias("s"))).where("x IS NOT NULL AND y IS NOT NULL")
    low = both.agg(*(f(c) for c in "xy" for f in (F.min, F.max)), F.count_if("s"), F.count_if(~F.col("s"))).first()
    if not low[4] + low[5]:
        return Tree(0.0, 0.0, 1.0, *(np.empty(0, np.int64) for _ in range(3)))
    side = (max(low[1] - low[0], low[3] - low[2]) or 1.0) * (1 + 1e-9)
    most = max(STATIONS, low[4] // LEAVES), max(POINTS, low[5] // LEAVES)
    base = Tree(low[0], low[2], side, *(np.empty(0, np.int64) for _ in range(3)))
    done: dict[int, tuple[int, int]] = {}
    hot, level = np.empty(0, np.int64), 0
    while level < LAST_LEVEL:
        step = FIRST_LEVEL if not level else STEP
        parents, upper, lower = hot, level, level + step

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y, s = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                if upper:
                    inside = np.isin(base.square(upper, x, y), parents)
                    x, y, s = x[inside], y[inside], s[inside].astype(bool)
                code, at = np.unique(base.square(lower, x, y), return_inverse=True)
                n = [np.bincount(at[side_], minlength=len(code)) for side_ in (s.astype(bool), ~s.astype(bool))]
                yield pa.RecordBatch.from_arrays([pa.array(code), *map(pa.array, n)], names=["code", "stations", "points"])

        counted = both.mapInArrow(count, "code long, stations long, points long").groupBy("code").agg(F.sum("stations"), F.sum("points")).collect()
        level = lower
        crowded = {c for c, s, p in counted if (s > most[0] or p > most[1]) and level < LAST_LEVEL}
        leaves = {c: (s, p) for c, s, p in counted if c not in crowded}
        done |= leaves if step == STEP else _joined(leaves, crowded, level, most)
        hot = np.array(sorted(crowded), np.int64)
        if not len(hot):
            break
    codes = np.array(sorted(done), np.int64)
    return Tree(base.x, base.y, side, codes, *(np.array([done[c][i] for c in codes.tolist()], np.int64) for i in (0, 1)))


def _joined(leaves: dict[int, tuple[int, int]], crowded: set[int], level: int, most: tuple[int, int]) -> dict[int, tuple[int, int]]:
    """Leaves of one level as larger ones, where all in such a one are few together."""
    out: dict[int, tuple[int, int]] = {}
    while level > 0:
        above: dict[int, list] = {}
        parent = lambda c: int(code_of(level - 1, np.int64((c >> 27) & 0x1FFFFFF), np.int64((c & 0x3FFFFFF) >> 1)))
        for c, n in leaves.items():
            above.setdefault(parent(c), []).append((c, n))
        split = {parent(c) for c in crowded}
        together: dict[int, tuple[int, int]] = {}
        for p, own in above.items():
            s, n = (sum(x[1][i] for x in own) for i in (0, 1))
            if p in split or s > most[0] or n > most[1]:
                split.add(p)
                out |= dict(own)
            else:
                together[p] = (s, n)
        leaves, crowded, level = together, split, level - 1
    return out | leaves


def k_nearest(points: DataFrame, stations: DataFrame, k: int, point_id: str = "cell", known: Tree | None = None) -> DataFrame:
    """(point id, x, y, near): the ``k`` nearest stations (id, x, y[, value]), nearest first, as structs with their squared distance ``d2``.

    All of them where they are fewer than ``k``; no row for points without coordinates, nor for any point where there is no station.
    ``known`` is a tree of the same tables.
    """
    spark = points.sparkSession
    more = [c for c in ("value",) if c in stations.columns]
    points = points.select(F.col(point_id).alias("__p"), F.col("x").cast("double"), F.col("y").cast("double"))
    stations = stations.select("id", F.col("x").cast("double"), F.col("y").cast("double"), *more).where("x IS NOT NULL AND y IS NOT NULL")
    made = known or tree(points, stations)
    kinds = {**dict(stations.dtypes), "p": dict(points.dtypes)["__p"]}

    def placed(df: DataFrame, names: list[str], leaf: str) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = made.leaf(*(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "xy"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*names, leaf])

        return df.select(*names).mapInArrow(place, ", ".join(f"{c} {t}" for c, t in df.select(*names).dtypes) + f", {leaf} long")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q in b.column(0).to_numpy():
                if made.points[q]:
                    wanted = made.needed(int(q), k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wanted), q)), pa.array(wanted)], names=["q", "leaf"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reached = spark.range(len(made.codes)).repartition(max(1, min(tasks, len(made.codes) // 64))).mapInArrow(reach, "q long, leaf long")
    there = placed(stations, ["id", "x", "y", *more], "s_leaf").join(reached, F.col("s_leaf") == F.col("leaf")).select("q", "id", "x", "y", *more).repartition(tasks, "q")
    here = placed(points.where("x IS NOT NULL AND y IS NOT NULL"), ["__p", "x", "y"], "p_leaf").repartition(tasks, "p_leaf")

    def pick(own: pa.Table, near: pa.Table) -> pa.Table:
        near = near.sort_by("id")
        px, py, sx, sy = (t[c].to_numpy() for t in (own, near) for c in "xy")
        n, step = min(k, len(near)), max(1, CHUNK // max(1, len(near)))
        take, dist = np.empty((len(own), n), np.int64), np.empty((len(own), n))
        for s in range(0, len(own), step):
            d2 = (px[s : s + step, None] - sx) ** 2 + (py[s : s + step, None] - sy) ** 2
            # rows are in the order of ids, so the first of equal distances has the smallest
            at = d2.argmin(1)[:, None] if n == 1 else np.argsort(d2, 1, kind="stable")[:, :n]
            take[s : s + step], dist[s : s + step] = at, np.take_along_axis(d2, at, 1)
        flat = pa.array(take.ravel())
        fields = [near[c].combine_chunks().take(flat) for c in ("id", "x", "y", *more)] + [pa.array(dist.ravel())]
        fields = [f.combine_chunks() if isinstance(f, pa.ChunkedArray) else f for f in fields]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * n), pa.StructArray.from_arrays(fields, names=["id", "x", "y", *more, "d2"]))
        out = pa.table({point_id: own["__p"], "x": own["x"], "y": own["y"], "near": lists})
        return out.slice(0, 0) if not len(near) else out

    struct = ", ".join(f"{c}: {kinds[c]}" for c in ("id", "x", "y", *more))
    return here.groupBy("p_leaf").cogroup(there.groupBy("q")).applyInArrow(pick, f"{point_id} {kinds['p']}, x double, y double, near array<struct<{struct}, d2: double>>")
