"""Residual noise: spatial-error weights and fits, ARMA(1,1) fits, seeded realizations.

A station has the neighbours within ``REACH_LENGTHS`` lengths.  A task holds the places of one group's stations and their values over a block of ``BLOCK`` times,
however long the run is.  Up to ``PAIRS`` pairs of neighbours are index arrays; with more the kernel is a product of one-dimensional ones between the nodes of
boxes (``Boxes``), so that memory and work grow with stations and not with their pairs.  A fit needs, of each station, three sums over
its times (the residual variance is quadratic in lambda) and the log determinant of I - lambda W: from eigenvalues up to ``DENSE`` stations, beyond
from Chebyshev traces, estimated by seeded probes over sparse products.  (I - lambda W) u = e is solved by Chebyshev iteration to a bounded residual.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocline.operators.steps import written

# Length scales tried, bounds of lambda, shrinkage of the weights, penalty, lattices of the ARMA fit.
LENGTHS_KM = (25.0, 50.0, 75.0, 100.0)
LAMBDA_BOUNDS = (0.0, 0.9)
SHRINK, PENALTY = 1.01, 0.1
REACH_LENGTHS = 7.0  # beyond it a kernel is below 1e-10
TILE, STRIPS, FILLED = 2048, 4, 256  # most stations of a packed row; strips of a square that its rows follow; stations of a square worth a row
SLAB = 1 << 15  # pairs of stations that a task weighs, and sends, at a time
SPREAD, FEW = 8, 512  # tasks a core among which packed rows meet; packed rows, of 64 kB at most, up to which they are broadcast
BLOCK = 32  # times in one task's block
PAIRS = 8_000_000  # most pairs of stations in squares side by side that a task lists
SIDE, NODES = 2.0, 18  # lengths of a box's side; its nodes in either direction: interpolation errs by less than 1e-12
WEAK = 0.1  # a station whose neighbours' kernels sum to less has its pairs listed, as its weights are small numbers scaled up
COLUMNS = 1 << 24  # numbers at nodes that are held at a time
BLOCK_STEPS = 512  # steps of a simulated series that one row holds
DENSE = 1500  # stations up to which eigenvalues give the log determinant
PROBES, MOMENTS, TOGETHER = 64, 64, 16  # random vectors and Chebyshev traces of its estimate; vectors taken at a time
RESIDUAL = 1e-11  # of a solve, relative to its right side
COARSE, FINE, REACH, EDGE, MIN_SERIES = 39, 21, 0.1, 0.99, 12


def _known(stations: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """(keys, id, x, y, h) of stations that have a place."""
    infinite = F.lit(float("inf"))
    rows = stations.select(*keys, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), length.cast("double").alias("h"))
    return rows.where(F.col("id").isNotNull() & (F.abs("x") < infinite) & (F.abs("y") < infinite)).dropna(subset=[*keys, "h"])


def _wide(rows: DataFrame, keys: list[str], reach: float) -> float:
    """How many times reach * h a square's side is, so that where stations are scattered a square has some ``FILLED`` of them."""
    squares = rows.groupBy(*keys, *[F.floor(F.col(c) / (F.col("h") * reach)).alias(f"c{c}") for c in "xy"]).agg(F.count(F.lit(1)).alias("n"))
    occupied, stations = squares.agg(F.count(F.lit(1)), F.sum("n")).first()
    return float(np.ceil(max(1.0, FILLED * occupied / stations) ** 0.5)) if occupied else 1.0


def _packed(rows: DataFrame, keys: list[str], reach: float, wide: float, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cx, cy, h, tile, x0, x1, y0, y1, arrays of id, x, y, more): stations (keys, id, x, y, more, h) of a square, ``TILE`` at most to a row.

    A square's side is wide * reach * h.  Its stations follow each other by strips of it, so that the more they are, the smaller is a row's box.
    """
    side = F.col("h") * reach * wide
    order = [*keys, "cx", "cy", "strip", "y"]
    placed = rows.select(*keys, F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"), "h", F.floor(F.col("x") / side * STRIPS).alias("strip"), "id", "x", "y", *more)
    types, by, arrays = dict(placed.dtypes), [*keys, "cx", "cy"], ["id", "x", "y", *more]
    schema = ", ".join([f"`{c}` {types[c]}" for c in [*by, "h"]] + ["tile long, x0 double, x1 double, y0 double, y1 double"] + [f"{c} array<{types[c]}>" for c in arrays])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in itertools.chain(batches, [None]):
            held += [batch] if batch is not None and len(batch) else []
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.arange(len(table)) == 0
            for c in by if len(table) > 1 else ():
                new[1:] |= pa.compute.not_equal(table[c][1:], table[c][:-1]).to_numpy()
            first = np.flatnonzero(new)
            starts = np.flatnonzero((np.arange(len(table)) - np.repeat(first, np.diff(np.append(first, len(table))))) % TILE == 0)
            held = []
            if batch is not None:  # the last packed row may go on in the next batch
                held, table, starts = table.slice(starts[-1]).to_batches(), table.slice(0, starts[-1]), starts[:-1]
            if len(starts):
                bounds = pa.array(np.append(starts, len(table)).astype(np.int32))
                out = {c: table[c].take(pa.array(starts)).combine_chunks() for c in [*by, "h"]} | {"tile": pa.array(number + np.arange(len(starts)))}
                out |= {f"{c}{n}": pa.array(f.reduceat(table[c].to_numpy(), starts)) for c in "xy" for n, f in enumerate((np.minimum, np.maximum))}
                out |= {c: pa.ListArray.from_arrays(bounds, table[c].combine_chunks()) for c in arrays}
                number += len(starts)
                yield pa.RecordBatch.from_pydict(out)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(pack, schema))


def _met(tiles: DataFrame, keys: list[str], reach: float, more: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """(keys, h, i_..., j_...): any two rows of ``_packed`` whose boxes are within reach, dealt evenly over tasks; ``once``: in one order only."""
    box = ["tile", "x0", "x1", "y0", "y1"]
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("n")
    here = tiles.select(*keys, "cx", "cy", "h", *[F.col(c).alias(f"i_{c}") for c in box])
    there = tiles.select(*keys, "cx", "cy", *[F.col(c).alias(f"j_{c}") for c in box], around)
    there = there.select(*keys, (F.col("cx") + F.col("n.a")).alias("cx"), (F.col("cy") + F.col("n.b")).alias("cy"), *[f"j_{c}" for c in box])
    gap = [F.greatest(F.col(f"j_{c}0") - F.col(f"i_{c}1"), F.col(f"i_{c}0") - F.col(f"j_{c}1"), F.lit(0.0)) for c in "xy"]
    side = F.col("h") * reach
    near = here.join(there, [*keys, "cx", "cy"]).where((gap[0] * gap[0] + gap[1] * gap[1] <= side * side) & (F.col("i_tile") <= F.col("j_tile") if once else F.lit(True)))
    n, stations = tiles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("id")), F.lit(0))).first()
    few, spread = n <= FEW, max(1, min(SPREAD * tiles.sparkSession.sparkContext.defaultParallelism, stations * stations // PAIRS))
    near = near.select(*keys, "h", "i_tile", "j_tile").repartition(spread, "i_tile", "j_tile")
    for a, arrays in (("i", ("id", "x", "y", *more)), ("j", ("id", "x", "y"))):
        own = tiles.select(F.col("tile").alias(f"{a}_tile"), *[F.col(c).alias(f"{a}_{c}") for c in arrays])
        near = near.join(F.broadcast(own) if few else own, f"{a}_tile")
    return near


def _each(batch: pa.RecordBatch, n: int, names: list[str]) -> list[np.ndarray]:
    """The arrays of row ``n`` of ``_met``."""
    return [batch[c][n].values.to_numpy(zero_copy_only=False) for c in names]


def _slabs(ix: np.ndarray, iy: np.ndarray, jx: np.ndarray, jy: np.ndarray, shared: tuple[np.ndarray, np.ndarray] | None, side: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray | None]]:
    """(some of the first stations, squared distances from all of the others, which of them are neighbours: None where all are).

    ``shared``: the others' ids beside the first ones', where any is the same.
    """
    far = [max(a.max() - b.min(), b.max() - a.min()) for a, b in ((ix, jx), (iy, jy))]
    inside = shared is None and far[0] * far[0] + far[1] * far[1] <= side * side
    step = max(1, SLAB // len(jx))
    for at in range(0, len(ix), step):
        some = slice(at, min(at + step, len(ix)))
        d2, dy = ix[some, None] - jx, iy[some, None] - jy
        d2 *= d2
        dy *= dy
        d2 += dy
        near = None if inside else d2 <= side * side
        if shared is not None:
            near &= shared[0][some, None] != shared[1]
        yield some, d2, near


def _rows(met: DataFrame, keys: list[str], reach: float, value: Callable, more: str | None, name: str) -> DataFrame:
    """(keys, i, j, ``name``) of all neighbours in ``_met``: ``value(kernel, the first station's number of more)``."""
    types = dict(met.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{c} {types[f'{c}_id'].removeprefix('array<')[:-1]}" for c in "ij"] + [f"{name} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                h = batch["h"][n].as_py()
                i, ix, iy, j, jx, jy = _each(batch, n, ["i_id", "i_x", "i_y", "j_id", "j_x", "j_y"])
                own = _each(batch, n, [f"i_{more}"])[0] if more else np.ones(len(i))
                kinds = [batch[c].type.value_type for c in ("i_id", "j_id")]
                for some, d2, near in _slabs(ix, iy, jx, jy, (i, j) if np.isin(i, j).any() else None, h * reach):
                    if near is None:
                        counts, to, of = len(j), np.tile(j, len(d2)), d2.ravel()
                    else:
                        counts, to, of = np.count_nonzero(near, axis=1), np.broadcast_to(j, d2.shape)[near], d2[near]
                    if len(to):
                        of /= -2 * h * h
                        np.exp(of, out=of)
                        w = value(of, np.repeat(own[some], counts))
                        fixed = [pa.repeat(batch[k][n], len(to)) for k in keys]
                        yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.repeat(i[some], counts), kinds[0]), pa.array(to, kinds[1]), pa.array(w)], names=[*keys, "i", "j", name])

    return met.mapInArrow(run, schema)


def kernel(stations: DataFrame, keys: list[str], length: Column, reach: float = REACH_LENGTHS) -> DataFrame:
    """(keys, i, j, k): exp(-d2 / 2 h2) of stations (keys, id, x, y) within ``reach`` lengths of each other.

    ``length`` is constant for equal keys.  Stations are packed by squares of side reach * length or more that they lie in; packed rows of
    squares side by side meet, so that no pair of stations is shuffled and a crowded square is spread over tasks.
    """
    rows = _known(stations, keys, length)
    tiles = _packed(rows, keys, reach, _wide(rows, keys, reach))
    return _rows(_met(tiles, keys, reach), keys, reach, lambda k, _: k, None, "k")


def _totals(met: DataFrame, reach: float) -> DataFrame:
    """(id, total): sums of the kernel over the neighbours of an id, from packed rows that met once; they leave a task added within a row."""
    kind = dict(met.dtypes)["i_id"].removeprefix("array<")[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                h, same = batch["h"][n].as_py(), batch["i_tile"][n] == batch["j_tile"][n]
                i, ix, iy, j, jx, jy = _each(batch, n, ["i_id", "i_x", "i_y", "j_id", "j_x", "j_y"])
                sums, met = [np.zeros(len(i)), np.zeros(len(j))], [np.zeros(len(i), bool), np.zeros(len(j), bool)]
                for some, d2, near in _slabs(ix, iy, jx, jy, (i, j) if np.isin(i, j).any() else None, h * reach):
                    d2 /= -2 * h * h
                    np.exp(d2, out=d2)
                    if near is not None:
                        d2 *= near
                    sums[0][some], met[0][some] = d2.sum(1), True if near is None else near.any(1)
                    sums[1] += d2.sum(0)
                    met[1] |= True if near is None else near.any(0)
                for ids, k, some in list(zip((i, j), sums, met))[: 1 if same else 2]:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some], batch["i_id"].type.value_type), pa.array(k[some])], names=["id", "k"])

    return met.mapInArrow(run, f"id {kind}, k double").groupBy("id").agg(F.sum("k").alias("total"))


def gaussian_weights(stations: DataFrame, length: float, reach: float = REACH_LENGTHS, digits: int | None = None) -> DataFrame:
    """(i, j, w) of one network of stations (id, x, y): the kernel with rows that sum to 1 / 1.01, rounded to ``digits`` as ``scalars.half_even`` does.

    The shrinkage follows the spectral radius 1 that any station with a neighbour implies; a station without one has no rows.
    The kernel is made twice, for its sums and for the rows, so that its pairs, whose number grows with the square of a crowded network's
    stations, neither cross a shuffle nor are held.
    """
    rows = _known(stations, [], F.lit(length))
    wide = _wide(rows, [], reach)
    totals = written(_totals(_met(_packed(rows, [], reach, wide), [], reach, once=True), reach))
    tiles = _packed(rows.join(totals, "id"), [], reach, wide, ("total",))
    scale = None if digits is None else float(10**digits)

    def weigh(k: np.ndarray, total: np.ndarray) -> np.ndarray:
        total *= SHRINK
        k /= total
        if scale is not None:
            k *= scale
            np.rint(k, out=k)
            k /= scale
        return k

    return _rows(_met(tiles, [], reach, ("total",)), [], reach, weigh, "total", "w")


def dense_weights(xy: np.ndarray, length: float) -> np.ndarray:
    """The weights of all pairs as a matrix: rows with any weight sum to 1 before the scale; where a station has no neighbour, the spectral radius decides on the scale."""
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    k = np.exp(-d2 / (2 * length * length))
    np.fill_diagonal(k, 0)
    total = k.sum(1)
    w = k / np.where(total > 0, total, 1)[:, None]
    if (total > 0).all():
        return w / SHRINK
    radius = spectral_radius(w)
    return w / (radius + 0.01) if radius >= 1 - 1e-6 else w


def spectral_radius(w: np.ndarray, rounds: int = 100, tolerance: float = 1e-8) -> float:
    """The largest absolute eigenvalue, by power iteration from the vector of ones."""
    v, now = np.ones(len(w)) / np.sqrt(len(w)), 0.0
    for _ in range(rounds):
        u = w @ v
        size = float(np.linalg.norm(u))
        if size < 1e-300 or abs(size - now) < tolerance:
            return size
        v, now = u / size, size
    return now


def minimize_bounded(f, lo: float, hi: float, tolerance: float = 1e-6, most: int = 200) -> tuple[float, float]:
    """Brent's minimum of ``f`` between two bounds: parabolas through the best points, golden sections otherwise."""
    golden = (3 - 5**0.5) / 2
    x = w = v = lo + golden * (hi - lo)
    fx = fw = fv = f(x)
    step = before = 0.0
    for _ in range(most):
        middle = (lo + hi) / 2
        tol = 1e-9 * abs(x) + tolerance / 3
        if abs(x - middle) <= 2 * tol - (hi - lo) / 2:
            break
        parabola = False
        if abs(before) > tol:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p if q > 0 else p), abs(q)
            if abs(p) < abs(q * before / 2) and q * (lo - x) < p < q * (hi - x):
                before, step, parabola = step, p / q, True
                if x + step - lo < 2 * tol or hi - x - step < 2 * tol:
                    step = tol if x < middle else -tol
        if not parabola:
            before = (hi if x < middle else lo) - x
            step = golden * before
        u = x + (step if abs(step) >= tol else (tol if step > 0 else -tol))
        fu = f(u)
        if fu <= fx:
            lo, hi = (x, hi) if u >= x else (lo, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            lo, hi = (u, hi) if u < x else (lo, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def sem_objective(n: np.ndarray, weights: np.ndarray, lam: float, log_det) -> float:
    """Penalised profile negative log likelihood of residuals (time, station), gaps as NaN counting as zero."""
    valid = ~np.isnan(n)
    filled = np.where(valid, n, 0.0)
    e = filled - lam * filled @ weights.T
    s2 = (np.where(valid, e, 0.0) ** 2).sum(0) / np.maximum(valid.sum(0), 1)
    if (s2 <= 0).any():
        return 1e30
    return len(n) / 2 * float(np.log(s2).sum()) - len(n) * log_det(lam) + float(valid.sum()) / 2 - PENALTY * np.log(max(1 - lam, 1e-10))


def fit_sem(n: np.ndarray, xy: np.ndarray, length: float) -> tuple[float, float, np.ndarray]:
    """(lambda, objective, innovations): the log determinant comes from eigenvalues of a similar symmetric matrix."""
    w = dense_weights(xy, length)
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    k = np.exp(-d2 / (2 * length * length))
    np.fill_diagonal(k, 0)
    total = k.sum(1)
    if (total > 1e-10).all():
        root = 1 / np.sqrt(total)
        eig = np.linalg.eigvalsh(k * root[:, None] * root[None]) / SHRINK
    else:
        eig = np.linalg.eigvals(w)

    def log_det(lam: float) -> float:
        return float(np.log(np.abs(1 - lam * eig)).sum())

    lam, value = minimize_bounded(lambda x: sem_objective(n, w, x, log_det), *LAMBDA_BOUNDS)
    filled = np.nan_to_num(n)
    return lam, value, np.where(np.isnan(n), np.nan, filled - lam * filled @ w.T)


@dataclass(frozen=True)
class Sparse:
    """A square matrix by rows: ids in order, where each row starts, columns and values."""

    ids: np.ndarray
    start: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        """The product with (rows, times)."""
        out = np.zeros_like(x)
        some = np.flatnonzero(np.diff(self.start))
        if len(some):
            for c in range(0, x.shape[1], 8):
                out[some, c : c + 8] = np.add.reduceat(self.value[:, None] * x[self.column, c : c + 8], self.start[some])
        return out

    def squares(self) -> float:
        """The sum of squared entries."""
        return float((self.value**2).sum())


def sparse(ids: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> Sparse:
    """From entries whose rows and columns are among ``ids``."""
    ids = np.unique(ids)
    row, column = np.searchsorted(ids, i), np.searchsorted(ids, j)
    order = np.lexsort((column, row))
    return Sparse(ids, np.searchsorted(row[order], np.arange(len(ids) + 1)), column[order], value[order])


def _side_by_side(x: np.ndarray, y: np.ndarray, side: float) -> tuple[dict[tuple[int, int], np.ndarray], int]:
    """(stations of each square, number of pairs in squares side by side)."""
    square = np.stack([np.floor(x / side), np.floor(y / side)], 1).astype(np.int64)
    names, at, counts = np.unique(square, axis=0, return_inverse=True, return_counts=True)
    parts = np.split(np.argsort(at.ravel(), kind="stable"), np.cumsum(counts)[:-1])
    held = {(int(a), int(b)): own for (a, b), own in zip(names, parts)} if len(x) else {}
    n = sum(len(own) * sum(len(held.get((a + i, b + j), ())) for i in (-1, 0, 1) for j in (-1, 0, 1)) for (a, b), own in held.items())
    return held, n


def _pairs(x: np.ndarray, y: np.ndarray, length: float, squares: dict[tuple[int, int], np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, k) of the stations that ``of`` marks and their neighbours within reach, whose squares have that side."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for (a, b), own in squares.items():
        own = own[of[own]]
        if len(own):
            other = np.concatenate([squares[n] for i in (-1, 0, 1) for j in (-1, 0, 1) if (n := (a + i, b + j)) in squares])
            rows = max(1, PAIRS // len(other))
            for at in range(0, len(own), rows):
                some = own[at : at + rows]
                d2 = (x[some, None] - x[other]) ** 2 + (y[some, None] - y[other]) ** 2
                i, j = np.nonzero((d2 <= (REACH_LENGTHS * length) ** 2) & (some[:, None] != other))
                out.append((some[i], other[j], np.exp(-d2[i, j] / (2 * length * length))))
    return tuple(np.concatenate(c) for c in zip(*out))


class Boxes:
    """exp(-d2 / 2 h2) of all pairs of places, themselves included, by interpolation between Chebyshev nodes.

    The kernel is one of x times one of y.  Each box passes its stations' values to its nodes, nodes pass them to those of boxes within
    reach along x and then along y, and stations take them from their box's nodes.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, length: float):
        side = SIDE * length
        near = int(np.ceil(REACH_LENGTHS / SIDE)) + 1
        k = np.arange(NODES)
        nodes = np.cos(np.pi * (k + 0.5) / NODES)
        chebyshev = np.cos(np.arccos(nodes)[:, None] * k)
        chebyshev[:, 1:] *= 2
        self.basis, self.along, which = [], [], []
        for c in (x, y):
            c = c - (c.min() if len(c) else 0.0)
            box = np.floor(c / side).astype(np.int64)
            inside = np.clip(2 * (c / side - box) - 1, -1, 1)
            self.basis.append(np.cos(np.arccos(inside)[:, None] * k) @ chebyshev.T / NODES)
            boxes, at = np.unique(box, return_inverse=True)
            which.append(at.ravel())
            steps = []
            for b in boxes:
                # occupied boxes within reach lie side by side in order
                lo, hi = np.searchsorted(boxes, [b - near, b + near + 1])
                d = (nodes / 2 * side)[:, None] - (((boxes[lo:hi] - b) * side)[:, None] + nodes / 2 * side).ravel()
                steps.append((lo * NODES, hi * NODES, np.exp(-d * d / (2 * length * length))))
            self.along.append(steps)
        self.shape = tuple(len(a) for a in self.along)
        order = np.lexsort(which[::-1])
        cell = which[0][order] * max(self.shape[1], 1) + which[1][order]
        cells, starts = np.unique(cell, return_index=True)
        self.parts = [(int(c) // self.shape[1], int(c) % self.shape[1], own) for c, own in zip(cells, np.split(order, starts[1:]))]

    def _basis(self, own: np.ndarray) -> np.ndarray:
        return (self.basis[0][own][:, :, None] * self.basis[1][own][:, None, :]).reshape(len(own), -1)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        (a, b), p = self.shape, NODES
        columns = max(1, COLUMNS // max(1, a * b * p * p))
        for c in range(0, x.shape[1], columns):
            some = x[:, c : c + columns]
            t = some.shape[1]
            sent = np.zeros((a, p, b, p, t))
            for i, j, own in self.parts:
                sent[i, :, j] = (self._basis(own).T @ some[own]).reshape(p, p, t)
            sent = sent.reshape(a * p, b * p * t)
            met = np.concatenate([k @ sent[lo:hi] for lo, hi, k in self.along[0]]).reshape(a * p, b * p, t)
            met = np.concatenate([np.matmul(k, met[:, lo:hi]) for lo, hi, k in self.along[1]], axis=1).reshape(a, p, b, p, t)
            for i, j, own in self.parts:
                out[own, c : c + columns] = self._basis(own) @ met[i, :, j].reshape(p * p, t)
        return out


class Smooth:
    """The kernel of many pairs, a station with itself left out: ``Boxes`` among stations with weight around them, listed pairs of the others."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, length: float, squares: dict[tuple[int, int], np.ndarray], known: np.ndarray):
        self.ids = ids
        self.x, self.y, self.length = x, y, length
        self.strong = np.flatnonzero(known)
        around = (Boxes(x[known], y[known], length) @ np.ones((len(self.strong), 1)))[:, 0] - 1
        self.strong = self.strong[around >= WEAK]
        self.boxes = Boxes(x[self.strong], y[self.strong], length)
        weak = known.copy()
        weak[self.strong] = False
        i, j, k = _pairs(x, y, length, squares, weak)
        back = ~weak[j]
        at = np.arange(len(ids))
        self.listed = sparse(at, np.concatenate([i, j[back]]), np.concatenate([j, i[back]]), np.concatenate([k, k[back]]))
        self.total = (self @ np.ones((len(ids), 1)))[:, 0]

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = self.listed @ x
        own = x[self.strong]
        out[self.strong] += self.boxes @ own - own
        return out

    def squares(self, row: np.ndarray, column: np.ndarray) -> float:
        """The sum of squared entries, each times the numbers of its row and its column."""
        at = np.repeat(np.arange(len(self.ids)), np.diff(self.listed.start))
        a, b = row[self.strong, None], column[self.strong, None]
        narrow = Boxes(self.x[self.strong], self.y[self.strong], self.length / 2**0.5)
        return float((self.listed.value**2 * row[at] * column[self.listed.column]).sum() + (a * (narrow @ b - b)).sum())


@dataclass(frozen=True)
class Scaled:
    """A kernel with its rows and columns scaled."""

    kernel: Smooth
    row: np.ndarray
    column: np.ndarray

    @property
    def ids(self) -> np.ndarray:
        return self.kernel.ids

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return self.row[:, None] * (self.kernel @ (self.column[:, None] * x))

    def squares(self) -> float:
        return self.kernel.squares(self.row**2, self.column**2)


def network(ids: np.ndarray, x: np.ndarray, y: np.ndarray, length: float) -> Sparse | Smooth:
    """The kernel of stations with different ids; one without a place has no neighbours."""
    order = np.argsort(ids, kind="stable")
    ids, x, y = ids[order], x[order].astype(float), y[order].astype(float)
    known = np.isfinite(x) & np.isfinite(y)
    some = np.flatnonzero(known)
    squares, n = _side_by_side(x[some], y[some], REACH_LENGTHS * length)
    squares = {name: some[own] for name, own in squares.items()}
    if n > PAIRS:
        return Smooth(ids, x, y, length, squares, known)
    i, j, k = _pairs(x, y, length, squares, known)
    return sparse(ids, ids[i], ids[j], k)


def normalized(k: Sparse | Smooth) -> tuple[Sparse | Scaled, Sparse | Scaled]:
    """(weights whose rows sum to 1 / 1.01, the symmetric form that is similar to them without the shrinkage) of a kernel."""
    if isinstance(k, Smooth):
        inverse, one = np.where(k.total > 0, 1 / np.where(k.total > 0, k.total, 1), 0.0), np.ones(len(k.ids))
        return Scaled(k, inverse / SHRINK, one), Scaled(k, np.sqrt(inverse), np.sqrt(inverse))
    row = np.repeat(np.arange(len(k.ids)), np.diff(k.start))
    total = np.bincount(row, k.value, len(k.ids))
    return replace(k, value=k.value / total[row] / SHRINK), replace(k, value=k.value / np.sqrt(total[row] * total[k.column]))


def solve(w: Sparse | Scaled, lam: float, e: np.ndarray, radius: float = 1 / SHRINK) -> np.ndarray:
    """u with (I - lam W) u = e for (stations, times), by Chebyshev iteration: eigenvalues of W are real and within ``radius``."""
    d = abs(lam) * radius
    if d == 0:
        return e.copy()
    bound = RESIDUAL * np.maximum(np.abs(e).max(0, initial=0.0), 1e-300)
    u, r = np.zeros_like(e), e.copy()
    rho, step = d, np.zeros_like(e)
    for n in range(10_000):
        # the interval of eigenvalues of I - lam W is 1 - d to 1 + d
        if n == 0:
            step = r.copy()
        else:
            now = 1 / (2 / d - rho)
            step, rho = now * rho * step + 2 * now / d * r, now
        u += step
        r = e - u + lam * (w @ u)
        if (np.abs(r).max(0, initial=0.0) <= bound).all():
            return u
    raise ArithmeticError("the spatial solve does not converge")


def chebyshev_traces(s: Sparse | Scaled, probes: int = PROBES, moments: int = MOMENTS, seed: int = 812) -> tuple[np.ndarray, np.ndarray]:
    """(traces of T_0 .. of a symmetric matrix with eigenvalues in -1 .. 1, their standard errors); the first three are exact."""
    n = len(s.ids)
    signs = np.random.default_rng([seed, n]).choice(np.array([-1, 1], np.int8), (n, probes))
    sums = np.zeros((2 * moments, probes))
    for at in range(0, probes, TOGETHER):
        z, own = signs[:, at : at + TOGETHER].astype(float), sums[:, at : at + TOGETHER]
        before, now = z, s @ z
        own[0], own[1] = n, (z * now).sum(0)
        for k in range(1, moments):
            # products of neighbours give the traces of twice their order
            own[2 * k] = 2 * (now * now).sum(0) - n
            after = 2 * (s @ now) - before
            own[2 * k + 1] = 2 * (now * after).sum(0) - own[1]
            before, now = now, after
    mean, error = sums.mean(1), sums.std(1, ddof=1) / np.sqrt(probes)
    for k, exact in ((0, float(n)), (1, 0.0), (2, 2 * s.squares() - n)):
        mean[k], error[k] = exact, 0.0
    return mean, error


def log_determinant(traces: np.ndarray, lam: float) -> float:
    """log det(I - lam S) from Chebyshev traces: log(1 - lam x) is a series in T_k(x) with powers of r, lam = 2 r / (1 + r^2)."""
    if lam == 0:
        return 0.0
    r = (1 - np.sqrt(1 - lam * lam)) / lam
    k = np.arange(1, len(traces))
    return float(-np.log1p(r * r) * traces[0] - 2 * (r**k / k * traces[1:]).sum())


def network_log_det(s: Sparse | Scaled):
    """The function lambda -> log det(I - lambda W), W the shrunk weights that are similar to ``s`` / 1.01."""
    if len(s.ids) <= DENSE and isinstance(s, Sparse):
        full = np.zeros((len(s.ids), len(s.ids)))
        full[np.repeat(np.arange(len(s.ids)), np.diff(s.start)), s.column] = s.value
        eig = np.linalg.eigvalsh((full + full.T) / 2) / SHRINK
        return lambda lam: float(np.log(np.abs(1 - lam * eig)).sum())
    traces = chebyshev_traces(s)[0]
    return lambda lam: log_determinant(traces, lam / SHRINK)


def _taking_part(residuals: DataFrame, keys: list[str], min_times: int) -> DataFrame:
    """One value per (keys, id, t), of stations with ``min_times`` values or more, where at least two take part."""
    rows = residuals.where(F.col("value").isNotNull()).groupBy(*keys, "id", "t").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("value").alias("value"))
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "id"))).where(F.col("__n") >= min_times)
    rows = rows.withColumn("__least", F.min("id").over(Window.partitionBy(*keys))).withColumn("__most", F.max("id").over(Window.partitionBy(*keys)))
    return rows.where(F.col("__least") != F.col("__most")).select(*keys, "id", "x", "y", "t", "value")


def _by_block(values: DataFrame, places: DataFrame, keys: list[str], make: Callable, schema: str) -> DataFrame:
    """``make(key, values (keys, id, t, value), places (keys, id, x, y, more))`` of each group's block of times, beside all places of the group."""
    rows = values.withColumn("__block", F.floor(F.col("t").cast("double") / BLOCK).cast("long"))
    by = [*keys, "__block"]
    beside = rows.select(*by).distinct().join(places, keys)
    beside = beside.select(*[F.col(c).alias(f"w_{c}") for c in by], *[c for c in places.columns if c not in keys])
    tasks, other = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), [f"w_{c}" for c in by]
    # every block beside places has values
    return rows.repartition(tasks, *by).groupBy(*by).cogroup(beside.repartition(tasks, *other).groupBy(*other)).applyInArrow(make, schema)


def _network_of(net: pa.Table, length: float) -> Sparse | Smooth:
    return network(*[net[c].to_numpy() for c in ("id", "x", "y")], length)


def _matrix(own: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(values (stations, times) of a block, gaps as NaN; where each row of it stands)."""
    times, when = np.unique(own["t"].to_numpy(), return_inverse=True)
    at = np.searchsorted(ids, own["id"].to_numpy()), when
    x = np.full((len(ids), len(times)), np.nan)
    x[at] = own["value"].to_numpy()
    return x, at


def _modelled(values: DataFrame, places: DataFrame, keys: list[str], make: Callable, out: str) -> DataFrame:
    """(keys, id, t, ``out``): ``make(weights, values (stations, times), lambda)`` of blocks of values, by places (keys, id, x, y, lambda, length)."""
    types = dict(values.dtypes)

    def run(key: tuple, own: pa.Table, net: pa.Table) -> pa.Table:
        if not len(own):
            return pa.table({**{k: own[k] for k in keys}, "id": own["id"], "t": own["t"], out: pa.array([], pa.float64())})
        w = normalized(_network_of(net, net["length"][0].as_py()))[0]
        x, at = _matrix(own, w.ids)
        return pa.table({**{k: pa.repeat(v, len(own)) for k, v in zip(keys, key)}, "id": own["id"], "t": own["t"], out: make(w, x, net["lambda"][0].as_py())[at]})

    return _by_block(values, places, keys, run, ", ".join(f"{k} {types[k]}" for k in [*keys, "id", "t"]) + f", {out} double")


def sem_model(residuals: DataFrame, keys: list[str], lengths=LENGTHS_KM, min_times: int = 2) -> DataFrame:
    """(keys, lambda, length, objective, n_stations): the least objective of all length scales.

    residuals: (keys, id, x, y, t, value), x and y in km; gaps count as zero for their neighbours.
    """
    types = dict(residuals.dtypes)
    part = written(_taking_part(residuals, keys, min_times))
    places = written(part.groupBy(*keys, "id").agg(F.min("x").alias("x"), F.min("y").alias("y")))
    named = ", ".join(f"{k} {types[k]}" for k in keys)
    group = [*keys, "length"]

    def lag(key: tuple, own: pa.Table, net: pa.Table) -> pa.Table:
        """Sums of a block's times for every station and length."""
        out = []
        for length in lengths if len(own) else ():
            w = normalized(_network_of(net, float(length)))[0]
            x, _ = _matrix(own, w.ids)
            some, mine = ~np.isnan(x), np.nan_to_num(x)
            lagged = np.where(some, w @ mine, 0.0)
            n = len(w.ids)
            sums = {"a": (mine * mine).sum(1), "b": (mine * lagged).sum(1), "c": (lagged * lagged).sum(1), "n": some.sum(1).astype(np.int64)}
            out.append(pa.table({**{k: pa.repeat(v, n) for k, v in zip(keys, key)}, "length": np.full(n, float(length)), "id": w.ids, **sums}))
        return pa.concat_tables(out) if out else pa.table({**{k: own[k] for k in keys}, "length": pa.array([], pa.float64()), "id": own["id"], **{c: pa.array([], pa.float64()) for c in "abc"}, "n": pa.array([], pa.int64())})

    # the residual variance of a station is quadratic in lambda
    sums = _by_block(part.select(*keys, "id", "t", "value"), places, keys, lag, f"{named}, length double, id {types['id']}, a double, b double, c double, n long")
    sums = sums.groupBy(*group, "id").agg(*[F.sum(c).alias(c) for c in "abcn"])
    span = part.groupBy(*keys).agg(F.count_distinct("t").alias("times"))
    schema = f"{named}, length double, lambda double, objective double, n_stations int"
    names = [*group, "lambda", "objective", "n_stations"]

    def fit(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("id")
        a, b, c, n = (own[k].to_numpy().astype(float) for k in "abcn")
        times = own["times"][0].as_py()
        log_det = network_log_det(normalized(_network_of(own, key[-1].as_py()))[1])

        def objective(lam: float) -> float:
            s2 = (a - 2 * lam * b + lam * lam * c) / np.maximum(n, 1)
            if (s2 <= 0).any():
                return 1e30
            return times / 2 * float(np.log(s2).sum()) - times * log_det(lam) + float(n.sum()) / 2 - PENALTY * np.log(max(1 - lam, 1e-10))

        lam, value = minimize_bounded(objective, *LAMBDA_BOUNDS)
        return pa.table({**{k: pa.repeat(v, 1) for k, v in zip(group, key)}, **dict(zip(names[len(group) :], (pa.array([lam]), pa.array([value]), pa.array([len(own)], pa.int32()))))})

    tasks = int(residuals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = written(sums).join(places, [*keys, "id"]).join(span, keys).repartition(tasks, *group).groupBy(*group).applyInArrow(fit, schema)
    best = fits.groupBy(*keys).agg(F.min(F.struct("objective", "length", "lambda", "n_stations")).alias("b"))
    return best.select(*keys, "b.lambda", "b.length", "b.objective", "b.n_stations")


def _model_places(places: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, x, y, lambda, length): places (keys, id, x, y) with what each model holds for them."""
    return places.join(models.select(*keys, "lambda", "length"), keys)


def innovations(residuals: DataFrame, models: DataFrame, keys: list[str], min_times: int = 2) -> DataFrame:
    """(keys, id, t, value): residuals less lambda times the weighted residuals of the neighbours; gaps count as zero there and stay gaps.

    residuals: (keys, id, x, y, t, value); models: (keys, lambda, length).  Stations with fewer than ``min_times`` values take no part, as in the fit.
    """
    part = _taking_part(residuals, keys, min_times)
    places = part.groupBy(*keys, "id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    known = part.select(*keys, "id", "t", "value").join(models.select(*keys), keys, "left_semi")
    return _modelled(known, _model_places(places, models, keys), keys, lambda w, x, lam: x - lam * (w @ np.nan_to_num(x)), "value")


def css(x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Conditional sums of squares of an ARMA(1,1) series, over a whole lattice of coefficients at once."""
    e = np.zeros(np.broadcast(phi, theta).shape)
    total = np.zeros_like(e)
    for t in range(1, len(x)):
        e = x[t] - phi * x[t - 1] - theta * e
        total += e * e
    return total


def fit_arma(x: np.ndarray) -> tuple[float, float, float]:
    """(phi, theta, variance) by a coarse lattice and a fine one around its best; gaps are closed; white for short series."""
    x = x[~np.isnan(x)]
    if len(x) < MIN_SERIES:
        return 0.0, 0.0, float(x.var()) if len(x) else 0.0
    axis = np.linspace(-0.95, 0.95, COARSE)
    p, q = np.meshgrid(axis, axis, indexing="ij")
    c = css(x, p, q)
    i = c.argmin()
    best = float(p.flat[i]), float(q.flat[i]), float(c.flat[i] / len(x))
    # the bounds of the fine lattice end at the edge, its points are spread between them
    sides = [np.linspace(max(v - REACH, -EDGE), min(v + REACH, EDGE), FINE) for v in best[:2]]
    p, q = np.meshgrid(*sides, indexing="ij")
    c = css(x, p, q)
    i = c.argmin()
    fine = float(p.flat[i]), float(q.flat[i]), float(c.flat[i] / len(x))
    return fine if fine[2] < best[2] else best


def arma_model(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, phi, theta, variance) per series of (keys, t, value)."""
    types = dict(residuals.dtypes)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [fit_arma(np.array([v["value"] for v in z], float)) for z in pdf["z"]]
            yield pd.concat([pdf[keys], pd.DataFrame(found, columns=["phi", "theta", "variance"], index=pdf.index)], axis=1)

    # rows are few and the work on them long: as many tasks as the session has partitions
    tasks = int(residuals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value")
    series = residuals.repartition(tasks, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", value))).alias("z"))
    return series.mapInPandas(fit, ", ".join(f"{k} {types[k]}" for k in keys) + ", phi double, theta double, variance double")


def arma_series(eta: np.ndarray, phi: float, theta: float, first: float | None = None) -> np.ndarray:
    """e_t = phi e_(t-1) + theta eta_(t-1) + eta_t, from 0 or ``first``."""
    out = np.zeros(len(eta))
    if len(eta) and first is not None:
        out[0] = first
    for t in range(1, len(eta)):
        out[t] = phi * out[t - 1] + theta * eta[t - 1] + eta[t]
    return out


def _eta(seed: int, key: tuple[Any, ...], block: int, variance: float, steps: int) -> np.ndarray:
    """The draws of a block of a series, the same on any cluster."""
    rng = np.random.default_rng([seed, block, *[zlib.crc32(str(k).encode()) for k in key]])
    return np.sqrt(max(variance, 0.0)) * rng.standard_normal(steps)


def simulate(models: DataFrame, keys: list[str], steps: int, seed: int = 812, block: int = BLOCK_STEPS) -> DataFrame:
    """(keys, t, noise): a realization e_t = phi e_(t-1) + theta eta_(t-1) + eta_t from e_0 = 0 per series of models (keys, phi, theta, variance).

    A series is cut into blocks of ``block`` steps, each drawn and run from 0 in a task of any series.  What goes before adds
    phi^(t - start) (phi e_last + theta eta_last) to a block, so its end is an affine map of the end before it: one
    fold over two numbers a block gives all starts, and blocks are completed apart.  Draws hang on the block's length.
    """
    names = [*keys, "b"]
    schema = ", ".join(f"{k} {dict(models.dtypes)[k]}" for k in keys) + ", b int, phi double, theta double, own array<double>, eta_last double"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, last = [], []
            for *key, b, phi, theta, variance in zip(*[batch.column(c).to_pylist() for c in [*names, "phi", "theta", "variance"]]):
                size = min(block, steps - b * block)
                eta = _eta(seed, tuple(key), b, variance, size)
                own.append(arma_series(eta, phi, theta, None if b == 0 else eta[0]))
                last.append(eta[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*names, "phi", "theta"]], pa.array(own, pa.list_(pa.float64())), pa.array(last, pa.float64())], names=[*names, "phi", "theta", "own", "eta_last"])

    if steps < 1:
        return models.select(*keys, F.lit(0).alias("t"), F.lit(0.0).alias("noise")).where(F.lit(False))
    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = models.select(*keys, F.explode(F.sequence(F.lit(0), F.lit((steps - 1) // block))).alias("b"), *[F.col(c).cast("double") for c in ("phi", "theta", "variance")])
    drawn = written(blocks.repartition(tasks, *names).mapInArrow(draw, schema))
    ends = F.struct("b", F.element_at("own", -1).alias("own"), "eta_last", "phi", "theta", F.pow("phi", F.size("own") - 1).alias("decay"))
    nothing = F.struct(F.array().cast("array<double>").alias("carry"), F.lit(0.0).alias("e"), F.lit(0.0).alias("eta"))

    def follow(state: Column, end: Column) -> Column:
        carry = end["phi"] * state["e"] + end["theta"] * state["eta"]
        return F.struct(F.concat(state["carry"], F.array(carry)).alias("carry"), (end["own"] + end["decay"] * carry).alias("e"), end["eta_last"].alias("eta"))

    # two numbers a block: 516 blocks in a run of 22,000 years of months
    starts = drawn.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(ends)), nothing, follow)["carry"].alias("carry"))
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.posexplode("carry").alias("_b", "carry"))
    same = F.col("b") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    whole = drawn.join(starts, same).select(*names, "phi", "carry", F.posexplode("own").alias("i", "own"))
    return whole.select(*keys, (F.col("b") * block + F.col("i")).alias("t"), (F.col("own") + F.pow("phi", "i") * F.col("carry")).alias("noise"))


def inverse_sem(e: np.ndarray, xy: np.ndarray, lam: float, length: float) -> np.ndarray:
    """u with (I - lambda W) u = e for innovations (time, station)."""
    return np.linalg.solve(np.eye(len(xy)) - lam * dense_weights(xy, length), e.T).T


def spread_noise(noise: DataFrame, stations: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Spatially correlated noise (keys, id, t, u) of (keys, id, t, noise): sparse solves over all stations (id, x, y), a block of times in a task; gaps count as zero."""
    rows = noise.join(stations.select("id"), "id", "left_semi").join(models.select(*keys), keys, "left_semi")
    places = rows.select(*keys, "id").distinct().join(stations.select("id", "x", "y"), "id")
    values = rows.select(*keys, "id", "t", F.col("noise").alias("value"))
    return _modelled(values, _model_places(places, models, keys), keys, lambda w, x, lam: solve(w, lam, np.nan_to_num(x)), "u")


def realization(df: DataFrame, variable: str, keys: list[str]) -> DataFrame:
    """Adds value_real of (value, u[, offset]): a sum for temperature; a mean-preserving factor for precipitation."""
    if variable == "tas":
        return df.withColumn("value_real", F.col("value") + F.col("u"))
    spread = F.var_pop("u").over(Window.partitionBy(*keys))
    return df.withColumn("value_real", F.greatest((F.col("value") + F.col("offset")) * F.exp(F.col("u") - spread / 2) - F.col("offset"), F.lit(0.0)))
