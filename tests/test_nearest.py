"""Nearest stations by squares and natural neighbours by sets, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocline.operators import grids, nearest, sibson


def tables(spark, xy, at):
    stations = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    return stations, spark.createDataFrame([(c, float(x), float(y)) for c, (x, y) in enumerate(at)], "cell int, x double, y double")


def clustered(seed):
    """A dense cluster, a desert with few stations, equal distances and a place that several stations share."""
    rng = np.random.default_rng(seed)
    lattice = np.array([(900.0 + 10 * i, 900.0 + 10 * j) for i in range(6) for j in range(6)])
    xy = np.vstack([rng.normal(100, 0.5, (900, 2)), rng.uniform(0, 1000, (60, 2)), lattice, np.repeat([[500.0, 500.0]], 40, 0)])
    at = np.vstack([rng.normal(100, 0.7, (300, 2)), rng.uniform(-300, 1300, (300, 2)), lattice + 5, lattice, [[500, 500], [1e6, -1e6]]])
    return xy, at


@pytest.mark.parametrize("k", [1, 5, 60])
def test_nearest_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(nearest, "POINTS", 40)
    xy, at = clustered(1)
    stations, points = tables(spark, xy, at)
    d2 = (at[:, None, 0] - xy[None, :, 0]) ** 2 + (at[:, None, 1] - xy[None, :, 1]) ** 2
    want = {c: np.argsort(d2[c], kind="stable")[:k].tolist() for c in range(len(at))}
    got = {r.cell: [s.id for s in r.near] for r in nearest.k_nearest(points.repartition(5), stations.repartition(4), k).collect()}
    assert got == want
    if k == 1:
        assert {r.cell: r.id for r in grids.nearest_station(points, stations).collect()} == {c: w[0] for c, w in want.items()}


def test_leaves_hold_few_and_every_row_has_one(spark, monkeypatch):
    monkeypatch.setattr(nearest, "POINTS", 40)
    xy, at = clustered(2)
    stations, points = tables(spark, xy, at)
    made = nearest.tree(points, stations)
    assert made.stations.sum() == len(xy) and made.points.sum() == len(at)
    own = np.bincount(made.leaf(xy[:, 0], xy[:, 1]), minlength=len(made.codes))
    assert (own == made.stations).all() and made.points[made.stations <= nearest.STATIONS].max() <= 40
    # only the place that forty stations share stays above the bound
    assert (made.stations > nearest.STATIONS).sum() == 1


def test_no_stations_and_rows_without_coordinates(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "cell int, x double, y double")
    none = spark.createDataFrame([], "id int, x double, y double, value double")
    assert nearest.k_nearest(points, none, 3).count() == 0
    assert sorted(tuple(r) for r in sibson.inverse_distance(points, none).collect()) == [(1, None), (2, None)]
    one = spark.createDataFrame([(7, 3.0, 4.0, 2.5), (8, None, 1.0, 9.0), (9, 1.0, 1.0, None)], none.schema)
    assert sorted((r.cell, r.value) for r in sibson.inverse_distance(points, one).collect() if r.value) == [(1, 2.5)]


def test_inverse_distance_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    xy, at = rng.uniform(0, 10, (70, 2)), rng.uniform(-2, 12, (40, 2))
    v = rng.normal(size=70)
    stations, points = tables(spark, xy, at)
    got = {r.cell: r.value for r in sibson.inverse_distance(points, stations.join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id int, value double"), "id"), 5, 3.0).collect()}
    for c, q in enumerate(at):
        d = np.sqrt(((xy - q) ** 2).sum(1))
        near = np.argsort(d)[:5]
        w = d[near] ** -3.0
        assert abs(got[c] - (w @ v[near]) / w.sum()) < 1e-9


def plain(xy, values, q):
    """The value at a query by its full weights among the stations that report, the greatest twenty kept."""
    i, w = sibson.weights_at(q, xy, sibson.hull(xy))
    order = np.lexsort((i, -w))[: sibson.KEPT]
    return float(w[order] @ values[i[order]])


def test_sets_equal_weighing_from_nothing_and_few_cells_are_weighed_again(spark, monkeypatch):
    monkeypatch.setattr(sibson, "ROUNDS", (12, 30))
    rng = np.random.default_rng(4)
    xy, at = rng.uniform(0, 100, (90, 2)), np.vstack([rng.uniform(5, 95, (60, 2)), [[-20.0, 50.0], [130.0, 130.0]]])
    stations, points = tables(spark, xy, at)
    gone = {t: set(rng.choice(90, 3, replace=False).tolist()) if t % 3 else set() for t in range(7)} | {7: set(range(0, 90, 2)), 8: set(sibson.hull(xy).shape and np.argsort(xy[:, 0])[:12].tolist())}
    v = {(i, t): float(rng.normal()) for t in gone for i in range(90)}
    rows = [(i, t, v[i, t] if i not in gone[t] else None) for t in gone for i in range(90)]
    got = {(r.cell, r.t): r.value for r in sibson.interpolate_reported(spark.createDataFrame(rows, "id int, t int, value double"), points, stations).collect()}
    assert len(got) == len(at) * len(gone)
    for t, missing in gone.items():
        there = np.array([i for i in range(90) if i not in missing])
        for c, q in enumerate(at):
            assert abs(got[c, t] - plain(xy[there], np.array([v[i, t] for i in there]), q)) < 1e-7, (c, t)
    # of the sets with three gaps, only the cells beside them are weighed again
    neighbours = sibson.natural_neighbours(points, stations)
    members = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(90) if i not in gone[t]], "station_set long, id int")
    found = {(r.station_set, r.cell) for r in sibson.affected_points(neighbours, stations, members)[0].collect()}
    mine = {}
    for r in neighbours.collect():
        mine.setdefault(r.cell, set()).add(r.id)
    assert found == {(t, c) for t in (1, 2) for c, ids in mine.items() if ids & gone[t]} and 0 < len(found) < 40


def test_stations_at_one_place_are_one_and_few_stations_give_null(spark):
    xy = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (10.0, 10.0), (5.0, 5.0), (5.0, 5.0 + 1e-8)]
    stations, points = tables(spark, xy, [(5.0, 5.0), (4.0, 5.0), (2.0, 2.0), (50.0, 50.0)])
    value = [0.0, 0.0, 0.0, 0.0, 8.0, 12.0]
    rows = [(i, 0, value[i]) for i in range(6)] + [(i, 1, 1.0) for i in range(3)] + [(0, 2, None)] + [(i, 3, 2.0) for i in range(5)] + [(5, 3, None)]
    got = {(r.cell, r.t): r.value for r in sibson.interpolate_reported(spark.createDataFrame(rows, "id int, t int, value double"), points, stations).collect()}
    assert len(got) == 16 and all(got[c, t] is None for c in range(4) for t in (1, 2))
    assert got[0, 0] == 10.0 and abs(got[1, 0] - 8.0) < 1e-9 and abs(got[2, 0] - 40 / 13) < 1e-3 and got[3, 0] == 0.0
    assert all(abs(got[c, 3] - 2.0) < 1e-12 for c in range(4))


def test_weights_are_cut_to_the_greatest_without_scaling(spark):
    turn = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    xy = np.column_stack([np.cos(turn), np.sin(turn)]) * (10 + 0.001 * np.arange(40))[:, None]
    stations, points = tables(spark, xy, [(0.0, 0.0)])
    rows = sibson.sibson_weights(points, stations).collect()
    every = sibson.natural_neighbours(points, stations).agg(F.count(F.lit(1)), F.sum("w")).first()
    assert every[0] > 20 and abs(every[1] - 1) < 1e-12
    assert len(rows) == sibson.KEPT and sum(r.w for r in rows) < 1


def test_points_on_edges_of_a_ring_whatever_its_direction(spark):
    ring = [(25.0, -150.0), (25.0, -60.0), (60.0, -90.0), (60.0, -130.0)]
    on = {(60.0, -130.0): True, (60.0, -110.0): True, (60.0, -90.0): False, (60.0, -140.0): False, (25.0, -150.0): True, (25.0, -60.0): False, (60.01, -110.0): False}
    # a point on the western edge, as it is computed from its southern corner
    on |= {(25 + k * 0.07, -150.0 + (25 + k * 0.07 - 25) * (20.0 / 35)): True for k in range(1, 400)}
    df = spark.createDataFrame(list(on), "lat double, lon double")
    for corners in (ring, ring[::-1], ring[2:] + ring[:2]):
        got = df.select("lat", "lon", grids.point_in_rings(F.col("lat"), F.col("lon"), corners).alias("x")).collect()
        assert {(r.lat, r.lon): r.x for r in got} == on
