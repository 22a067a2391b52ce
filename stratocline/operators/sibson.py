"""Natural-neighbour (Sibson) interpolation by clipping Voronoi cells with half-planes.

The cell of a query point among its nearest stations is a box cut by bisectors;
what a station would lose to the query is that cell cut by the station's bisectors
with the others.  Areas are weights.  Nearer stations come first, and are enough when the next one can no
longer cut the cell and those taken surround the query; few queries need another round with more of them.
Queries outside the hull, or on a station, take the nearest one.  As published, a query keeps the weights of
its ``KEPT`` greatest neighbours as they are, not scaled again.

Weights depend on the natural neighbours alone, so a station that does not report changes only the queries that have it among
theirs: the full network is weighed once, and for a set of reporting stations only these queries again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocline.operators.grids import merge_locations
from stratocline.operators.nearest import Tree, k_nearest, tree
from stratocline.operators.steps import written

NEIGHBOURS = 24
BOX = 1e3  # half the side of the box that is cut, in widths of the network: cells of queries beside the hull are long
ROUNDS = (64, 1024)  # nearest stations that a query is weighed among; then all
KEPT, LEAST_VALID = 20, 4  # fixed values: neighbours that keep their weights, stations that a time needs
DIGITS = 6  # stations whose coordinates agree to so many decimals are one place


def cut_by(poly: np.ndarray, normal: np.ndarray, level: float) -> np.ndarray:
    """The part of a convex polygon with normal . p <= level."""
    if not len(poly):
        return poly
    side = poly @ normal - level
    if (side <= 0).all():
        return poly
    out = []
    for i in range(len(poly)):
        j = (i + 1) % len(poly)
        if side[i] <= 0:
            out.append(poly[i])
        if (side[i] < 0 < side[j]) or (side[j] < 0 < side[i]):
            out.append(poly[i] + (poly[j] - poly[i]) * (side[i] / (side[i] - side[j])))
    return np.array(out) if len(out) > 2 else np.empty((0, 2))


def area(poly: np.ndarray) -> float:
    if len(poly) < 3:
        return 0.0
    x, y = poly[:, 0], poly[:, 1]
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def bisector(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The half-plane of points nearer to ``a`` than to ``b``."""
    return b - a, float((b @ b - a @ a) / 2)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull by a monotone chain, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def in_hull(corners: np.ndarray, q: np.ndarray) -> bool:
    if len(corners) < 3:
        return False
    edge = np.roll(corners, -1, 0) - corners
    to = q - corners
    return bool((edge[:, 0] * to[:, 1] - edge[:, 1] * to[:, 0] >= -1e-9 * np.abs(edge).max()).all())


def cell_weights(near: np.ndarray, distance: np.ndarray, complete: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """(indexes, weights) of the natural neighbours of the origin among points at distances of about 1 at most, nearest first.

    None where points beyond those given might matter, which ``complete`` denies.
    """
    k = min(NEIGHBOURS, len(near))
    while True:
        cell = BOX * np.array([[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]])
        for s in near[:k]:
            cell = cut_by(cell, *bisector(np.zeros(2), s))
        radius = float(np.sqrt((cell**2).sum(1).max())) if len(cell) else 0.0
        if distance[k - 1] >= 2 * radius:
            break
        if k == len(near):
            if not complete:
                return None
            break
        k = min(2 * k, len(near))
    # natural neighbours are those whose bisectors bound the cell; inside it no other station's region has a part
    reach, level = (near[:k] @ cell.T).max(1) if len(cell) else np.zeros(k), distance[:k] ** 2 / 2
    touching = np.flatnonzero(reach >= level - 1e-9 * (level + radius * distance[:k]))
    lost = np.zeros(len(touching))
    for n, i in enumerate(touching):
        part = cell
        for j in touching:
            if j != i and len(part):
                part = cut_by(part, *bisector(near[i], near[j]))
        lost[n] = area(part)
    if lost.sum() <= 0:
        return np.zeros(1, np.int64), np.ones(1)
    keep = lost > 0
    return touching[keep], lost[keep] / lost.sum()


def weights_at(q: np.ndarray, stations: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, weights) of the natural neighbours of a query among all stations, of which ``corners`` is the hull."""
    d2 = ((stations - q) ** 2).sum(1)
    order = np.argsort(d2, kind="stable")
    scale = float(np.ptp(stations, axis=0).max()) or 1.0
    if on_place(d2[order[0]], scale) or not in_hull(corners, q):
        return order[:1], np.ones(1)
    i, w = cell_weights((stations[order] - q) / scale, np.sqrt(d2[order]) / scale, True)
    return order[i], w


def on_place(d2: float, scale: float) -> bool:
    return d2 < (1e-6 * max(scale, 1.0)) ** 2 * 1e-6


def surrounds(near: np.ndarray) -> bool:
    """Whether no half-plane through the origin is free of the points."""
    turn = np.sort(np.arctan2(near[:, 1], near[:, 0]))
    return len(turn) > 2 and max(np.diff(turn).max(), 2 * np.pi - (turn[-1] - turn[0])) <= np.pi + 1e-9


def hull_of(stations: DataFrame) -> np.ndarray:
    """The convex hull of (x, y): each task sends its own, whose corners are few."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corners = np.empty((0, 2))
        for b in batches:
            corners = hull(np.vstack([corners, np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])]))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(corners[:, i])) for i in (0, 1)], names=["x", "y"])

    rows = stations.select(F.col("x").cast("double"), F.col("y").cast("double")).where("x IS NOT NULL AND y IS NOT NULL").mapInArrow(build, "x double, y double").collect()
    return hull(np.array([tuple(r) for r in rows], float).reshape(-1, 2))


def _weigh(rows: DataFrame, keys: list[str], corners: np.ndarray, scale: float, complete: bool, kind: str) -> DataFrame:
    """(keys, id, w) of rows (keys, x, y, near[, gone]): all natural neighbours; one row without id where ``near`` does not suffice.

    ``gone`` lists stations of ``near`` that do not report; then the hull may be smaller than ``corners``.
    """
    names = [*keys, "id", "w"]
    types = dict(rows.dtypes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            take, ids, weights = [], [], []
            gone = b.column(at["gone"]).to_pylist() if "gone" in at else [None] * b.num_rows
            for n, (qx, qy, missing) in enumerate(zip(b.column(at["x"]).to_pylist(), b.column(at["y"]).to_pylist(), gone)):
                near = b.column(at["near"])[n].values
                own = near.field("id")
                xy = np.column_stack([near.field(c).to_numpy(zero_copy_only=False) for c in "xy"])
                if missing:
                    there = np.flatnonzero(~np.isin(np.array(own.to_pylist(), object), np.array(missing, object)))
                    own, xy = own.take(pa.array(there)), xy[there]
                made: tuple | None = None
                if len(xy):
                    d = np.sqrt(((xy - [qx, qy]) ** 2).sum(1))
                    if on_place(float(d[0] ** 2), scale) or not in_hull(corners, np.array([qx, qy])):
                        made = np.zeros(1, np.int64), np.ones(1)
                    else:
                        local = (xy - [qx, qy]) / scale
                        if "gone" in at and not surrounds(local):
                            made = (np.zeros(1, np.int64), np.ones(1)) if complete else None
                        else:
                            made = cell_weights(local, d / scale, complete)
                elif complete:
                    continue
                if made is None:
                    take.append(n)
                    ids.append(None)
                    weights.append(None)
                else:
                    take += [n] * len(made[0])
                    ids += own.take(pa.array(made[0])).to_pylist()
                    weights += made[1].tolist()
            own_type = b.schema.field("near").type.value_type.field("id").type
            kept = [b.column(at[c]).take(pa.array(take, pa.int64())) for c in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, own_type), pa.array(weights, pa.float64())], names=names)

    return rows.mapInArrow(build, ", ".join(f"{k} {types[k]}" for k in keys) + f", id {kind}, w double")


def natural_neighbours(points: DataFrame, stations: DataFrame, point_id: str = "cell", known: Tree | None = None, corners: np.ndarray | None = None) -> DataFrame:
    """(point id, id, w): all natural neighbours of points (point id, x, y) among stations (id, x, y) at distinct places.

    ``known`` and ``corners`` are the tree and the hull of the same tables.
    """
    made, corners, kind = known or tree(points, stations), hull_of(stations) if corners is None else corners, dict(stations.dtypes)["id"]
    count, out, todo = int(made.stations.sum()), None, points.select(point_id, "x", "y")
    for k in (*ROUNDS, count):
        near = k_nearest(todo, stations.select("id", "x", "y"), max(1, min(k, count)), point_id, made)
        weighed = _weigh(near, [point_id], corners, made.side, k >= count, kind)
        if k >= count:
            return weighed if out is None else out.unionByName(weighed)
        weighed = written(weighed)
        found = weighed.where(F.col("id").isNotNull())
        out = found if out is None else out.unionByName(found)
        left = weighed.where(F.col("id").isNull()).select(point_id)
        if left.isEmpty():
            return out
        todo = points.select(point_id, "x", "y").join(left, point_id)


def truncated(weights: DataFrame, keys: list[str]) -> DataFrame:
    """The ``KEPT`` greatest weights of each query, the smaller id first of equal ones."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), "id"))
    return weights.withColumn("__rank", rank).where(F.col("__rank") <= KEPT).drop("__rank")


def sibson_weights(points: DataFrame, stations: DataFrame, point_id: str = "cell") -> DataFrame:
    """(point id, id, w) of points (point id, x, y) among stations (id, x, y) at distinct places, the greatest ``KEPT`` of each point."""
    return truncated(natural_neighbours(points, stations, point_id), [point_id])


def interpolate(values: DataFrame, weights: DataFrame, point_id: str = "cell") -> DataFrame:
    """(point id, t, value) of station values (id, t, value): the sparse product as a join and a sum.

    Nulls are dropped; the weights present at a time are scaled to sum to one.
    """
    joined = values.where(F.col("value").isNotNull()).join(weights, "id")
    return joined.groupBy(point_id, "t").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"))


def places_of(stations: DataFrame) -> DataFrame:
    """(id, place, px, py): stations (id, x, y) with coordinates and the station of the smallest id at their place, whose coordinates count."""
    rows = stations.where("x IS NOT NULL AND y IS NOT NULL").select("id", F.col("x").cast("double"), F.col("y").cast("double"))
    rows = rows.withColumn("__x", F.rint(F.col("x") * 10**DIGITS)).withColumn("__y", F.rint(F.col("y") * 10**DIGITS))
    first = rows.groupBy(F.col("__x").alias("__fx"), F.col("__y").alias("__fy")).agg(F.min(F.struct("id", "x", "y")).alias("f"))
    joined = rows.join(first, (F.col("__x") == F.col("__fx")) & (F.col("__y") == F.col("__fy")))
    return joined.select("id", F.col("f.id").alias("place"), F.col("f.x").alias("px"), F.col("f.y").alias("py"))


def station_sets(values: DataFrame) -> DataFrame:
    """(t, station_set, n): times that share a set of reporting stations share a number, and so one set of weights.

    The number comes from sums over the distinct ids, without a list of them.
    """
    rows = values.where(F.col("value").isNotNull()).select("t", "id").distinct()
    one = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b"))
    return one.select("t", F.xxhash64("n", "a", "b").alias("station_set"), "n")


def affected_points(neighbours: DataFrame, network: DataFrame, members: DataFrame, point_id: str = "cell") -> tuple[DataFrame, DataFrame]:
    """(station_set, point id) whose natural neighbours (point id, id, w) in the network (id) do not all report in the set (station_set, id), and (station_set, id) of all that do not."""
    # as many rows as a dense table of sets by stations has gaps
    every = members.select("station_set").distinct().join(network.select("id"))
    missing = every.join(members.select("station_set", "id"), ["station_set", "id"], "left_anti")
    return missing.join(neighbours, "id").select("station_set", point_id).distinct(), missing


def set_weights(points: DataFrame, network: DataFrame, affected: DataFrame, missing: DataFrame, point_id: str, known: Tree, corners: np.ndarray) -> DataFrame:
    """(station_set, point id, id, w) of affected points among the stations of the network (id, x, y) that are not missing from the set."""
    kind, keys = dict(network.dtypes)["id"], ["station_set", point_id]
    count, out, todo = int(known.stations.sum()), None, affected
    for k in (*ROUNDS, count):
        cells = points.select(point_id, "x", "y").join(todo.select(point_id).distinct(), point_id)
        near = written(k_nearest(cells, network.select("id", "x", "y"), max(1, min(k, count)), point_id, known))
        listed = near.select(point_id, F.explode("near.id").alias("id")).join(missing, "id").join(todo, keys)
        gone = listed.groupBy(*keys).agg(F.collect_list("id").alias("gone"))  # of the nearest k
        rows = todo.join(near, point_id).join(gone, keys, "left").select(*keys, "x", "y", "near", F.coalesce("gone", F.array().cast(f"array<{kind}>")).alias("gone"))
        weighed = written(_weigh(rows, keys, corners, known.side, k >= count, kind))
        found = weighed.where(F.col("id").isNotNull())
        out = found if out is None else out.unionByName(found)
        left = weighed.where(F.col("id").isNull()).select(*keys)
        if k >= count or left.isEmpty():
            return truncated(out, keys)
        todo = left


def interpolate_reported(values: DataFrame, points: DataFrame, stations: DataFrame, point_id: str = "cell") -> DataFrame:
    """(point id, t, value) of values (id, t, value), each time by the natural neighbours among the stations (id, x, y) that report at it.

    Nulls and stations without a place do not report.  Stations at one place are one, with their mean value.  A time at which
    fewer than ``LEAST_VALID`` stations report gives null everywhere.  The network of all places that ever report is weighed
    once; times that share a set of places share what is weighed again for it.
    """
    placed = places_of(stations)
    there = values.where(F.col("value").isNotNull()).join(placed.select("id", "place"), "id")
    valid = values.select("t").distinct().join(there.groupBy("t").agg(F.count(F.lit(1)).alias("valid")), "t", "left")
    few = valid.where(F.coalesce("valid", F.lit(0)) < LEAST_VALID).select("t")
    merged = written(there.join(few, "t", "left_anti").groupBy("t", F.col("place").alias("id")).agg(F.avg("value").alias("value")))
    network = written(placed.where(F.col("id") == F.col("place")).select("id", F.col("px").alias("x"), F.col("py").alias("y")).join(merged.select("id").distinct(), "id", "left_semi"))
    known, corners = tree(points, network), hull_of(network)
    neighbours = written(natural_neighbours(points, network, point_id, known, corners))
    sets = written(station_sets(merged).select("t", "station_set"))
    one = sets.groupBy("station_set").agg(F.min("t").alias("t"))
    members = merged.select("t", "id").join(one, "t").select("station_set", "id")
    affected, missing = map(written, affected_points(neighbours, network, members, point_id))
    total: Column = F.sum(F.col("w") * F.col("value")).alias("value")
    out = merged.join(truncated(neighbours, [point_id]), "id").groupBy(point_id, "t").agg(total)
    if not affected.isEmpty():
        again = set_weights(points, network, affected, missing, point_id, known, corners)
        out = out.join(affected.join(sets, "station_set").select(point_id, "t"), [point_id, "t"], "left_anti")
        out = out.unionByName(merged.join(sets, "t").join(again, ["station_set", "id"]).groupBy(point_id, "t").agg(total))
    return out.unionByName(few.join(points.select(point_id)).select(point_id, "t", F.lit(None).cast("double").alias("value")))


def grid_values(values: DataFrame, stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Stations (id, x, y, value) merged by place and interpolated to cells (cell, x, y): (cell, value)."""
    merged = merge_locations(values.join(stations, "id").where(F.col("value").isNotNull())).withColumn("id", F.xxhash64("x", "y"))
    found = sibson_weights(cells, merged)
    return interpolate(merged.select("id", F.lit(0).alias("t"), "value"), found).select("cell", "value")


def inverse_distance(points: DataFrame, stations: DataFrame, k: int = 8, power: float = 2.0, point_id: str = "cell") -> DataFrame:
    """(point id, value) from the ``k`` nearest stations (id, x, y, value), as an alternative to natural neighbours; null where there is none."""
    near = k_nearest(points, stations.where(F.col("value").isNotNull()), k, point_id)
    weight = lambda s: 1 / F.pow(F.greatest(s["d2"], F.lit(1e-18)), F.lit(power / 2))
    total = F.aggregate("near", F.lit(0.0), lambda t, s: t + weight(s))
    found = near.select(F.col(point_id).alias("__p"), (F.aggregate("near", F.lit(0.0), lambda t, s: t + weight(s) * s["value"]) / total).alias("value"))
    return points.select(point_id).join(found, F.col(point_id) == F.col("__p"), "left").select(point_id, "value")
