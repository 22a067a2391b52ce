"""Percentiles by histograms, polygons from edge tables, noise of long runs by blocks: each against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocline.operators import grids, noise, raster
from stratocline.operators.percentiles import exact_percentiles

SHARES = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]


def plain(df, keys):
    return {tuple(r[k] for k in keys): r["p"] for r in df.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(p) for p in SHARES])).alias("p")).collect()}


@pytest.mark.parametrize(("points", "leaf"), [(8, 20), (256, 10_000)])
def test_percentiles_equal_the_aggregate(spark, points, leaf):
    rng = np.random.default_rng(3)
    rows = [("ties", float(v)) for v in rng.integers(0, 5, 900)] + [("wide", float(v)) for v in np.exp(rng.normal(0, 60, 700))] + [("one", 4.5)]
    rows += [(None, float(v)) for v in rng.normal(size=300)] + [("huge", v) for v in (-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324)] + [("same", -2.0)] * 400
    df = spark.createDataFrame([*rows, ("gap", None)], "k string, v double")
    got = {(r["k"],): r["percentiles"] for r in exact_percentiles(df, ["k"], "v", SHARES, points=points, leaf=leaf).collect()}
    want = plain(df.where("v is not null"), ["k"])
    assert got == want
    whole = exact_percentiles(df, [], "v", SHARES, points=points, leaf=leaf).collect()
    assert [r["percentiles"] for r in whole] == [plain(df.where("v is not null"), [])[()]]
    assert whole[0]["n"] == len(rows)


def test_percentiles_of_nothing(spark):
    odd = spark.createDataFrame([(1, None, 9), (1, float("nan"), 9), (2, float("inf"), 9)], "k int, v double, n int")
    assert exact_percentiles(odd, ["k"], "v", [0.5]).collect() == []
    assert exact_percentiles(odd.where("k > 5"), [], "v", [0.5]).collect() == []


def parity(lat, lon, edges):
    odd = np.zeros(np.broadcast(lat, lon).shape, bool)
    for a_lat, a_lon, b_lat, b_lon in edges:
        if a_lat != b_lat:
            odd ^= ((a_lat > lat) != (b_lat > lat)) & (lon < (lat - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat)) + a_lon)
    return odd


def ring(n, lat, lon, radius, rng):
    angle = np.arange(n) * 2 * np.pi / n
    far = radius * (1 + 0.3 * np.sin(7 * angle) + 0.05 * rng.normal(size=n))
    return [(i, float(lat + f * np.sin(a)), float(lon + 2 * f * np.cos(a))) for i, (a, f) in enumerate(zip(angle, far))]


def corners(spark, rings):
    return spark.createDataFrame([(k, part, *c) for k, part, points in rings for c in points], "polygon string, part int, i int, lat double, lon double")


def test_raster_with_holes_equals_parity(spark):
    rng = np.random.default_rng(5)
    grid = grids.GridSpec(20.0, 60.0, -140.0, -80.0, 0.5)
    rings = [("coast", 0, ring(3000, 40, -110, 12, rng)), ("coast", 1, ring(200, 41, -109, 4, rng)), ("off", 0, ring(50, 60, -140, 9, rng))]
    # corners on grid points and level edges
    rings.append(("square", 0, [(0, 30.0, -120.0), (1, 30.0, -110.0), (2, 35.0, -110.0), (3, 35.0, -120.0)]))
    edges = raster.edges_of(corners(spark, rings), ["polygon", "part"], "i").drop("part")
    got = {}
    for r in raster.rasterize(edges, ["polygon"], grid).collect():
        got.setdefault(r["polygon"], []).append(r["cell"])
    lat = (20.0 + np.arange(grid.shape[0]) * 0.5)[:, None]
    lon = (-140.0 + np.arange(grid.shape[1]) * 0.5)[None, :]
    by_polygon = {}
    for r in edges.collect():
        by_polygon.setdefault(r["polygon"], []).append((r["a_lat"], r["a_lon"], r["b_lat"], r["b_lon"]))
    for k, e in by_polygon.items():
        assert sorted(got[k]) == np.flatnonzero(parity(lat, lon, e).ravel()).tolist(), k
    assert len(got["square"]) == 10 * 20

    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(20, 60, 500), rng.uniform(-140, -80, 500)))] + [(900, None, 1.0)], "id int, lat double, lon double")
    inside = {(r["polygon"], r["id"]) for r in raster.points_inside(points, edges, ["polygon"]).collect()}
    placed = points.where("lat is not null").toPandas()
    want = {(k, int(placed.id[i])) for k, e in by_polygon.items() for i in np.flatnonzero(parity(placed.lat.to_numpy(), placed.lon.to_numpy(), e))}
    assert inside == want and want


def test_raster_of_many_edges(spark):
    """A coast of 100,000 edges: no expression an edge, the whole equal to the polygon as one expression on a thinned copy's points."""
    points = ring(100_000, 45, -110, 14, np.random.default_rng(1))
    edges = raster.edges_of(corners(spark, [("coast", 0, points)]), ["polygon"], "i")
    grid = grids.GridSpec(25.0, 65.0, -150.0, -70.0, 2.0)
    got = sorted(r["cell"] for r in raster.rasterize(edges, ["polygon"], grid).collect())
    a = np.array([p[1:] for p in points])
    b = np.roll(a, -1, axis=0)
    inside = []
    for i in range(grid.shape[0]):
        lat = 25.0 + i * 2.0
        cut = (a[:, 0] > lat) != (b[:, 0] > lat)
        at = (lat - a[cut, 0]) * ((b[cut, 1] - a[cut, 1]) / (b[cut, 0] - a[cut, 0])) + a[cut, 1]
        inside += [i * grid.shape[1] + j for j in range(grid.shape[1]) if (-150.0 + j * 2.0 < at).sum() % 2]
    assert got == inside and len(got) > 200


@pytest.mark.parametrize("crowd", [1, 16, 10**6])
def test_points_among_odd_edges_equal_parity(spark, crowd):
    """Corners in the latitudes and longitudes of points, places and edges that stand twice, towns, both zeros, numbers that are none."""
    rng = np.random.default_rng(11)
    n = 300
    places = np.vstack([rng.integers(-6, 7, (n, 2)), rng.uniform(-6, 6, (n, 2)), rng.uniform(1, 1.001, (n, 2)), np.full((40, 2), 2.0), [[-0.0, 0.0], [0.0, -0.0], [-0.0, -0.0], [np.nan, 1], [1, np.nan], [np.inf, 0], [0, -np.inf]]])
    nodes = np.vstack([rng.integers(-6, 7, (60, 2)), rng.uniform(-6, 6, (60, 2)), rng.uniform(1, 1.001, (60, 2)), [[0.0, 0.0], [-3.0, -0.0], [3.0, 0.0], [5e-324, 2.0], [0.0, -2.0]]])
    rings = {"a": nodes[rng.permutation(len(nodes))], "b": nodes[rng.permutation(len(nodes))], None: nodes[:7]}
    listed = [(k, *map(float, (*a, *b))) for k, ring_ in rings.items() for a, b in zip(ring_, np.roll(ring_, -1, 0))]
    listed += listed[:40] + listed[:9]
    edges = spark.createDataFrame([*listed, ("a", None, 1.0, 2.0, 3.0), ("c", -6.0, None, 6.0, 3.0)], "polygon string, a_lat double, a_lon double, b_lat double, b_lon double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)] + [(9000, None, 1.0), (9001, 1.0, None)], "id int, lat double, lon double")
    got = [(r["polygon"], r["id"]) for r in raster.points_inside(points, edges, ["polygon"], crowd=crowd).collect()]
    want = {(k, int(i)) for k in rings for i in np.flatnonzero(parity(*places.T, [e[1:] for e in listed if e[0] == k]))}
    assert set(got) == want and len(got) == len(want) > 300


def test_points_meet_few_of_many_long_edges(spark):
    """Edges from end to end of the map: hardly any is tested against a place, where all with its latitude were before."""
    rng = np.random.default_rng(12)
    n = 4000
    ends = rng.uniform(0, 100, (n, 2))
    edges = raster.edges_of(spark.createDataFrame([("far", i, float(a), float(b)) for i, (a, b) in enumerate(ends)], "polygon string, i int, lat double, lon double"), ["polygon"], "i")
    places = rng.uniform(0, 100, (n, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)], "id int, lat double, lon double")
    near = raster._met(points.select("lat", "lon"), edges, ["polygon"], 16)[1]
    assert near.count() < n * n / 8
    listed = [(*a, *b) for a, b in zip(ends, np.roll(ends, -1, 0))]
    assert {r["id"] for r in raster.points_inside(points, edges, ["polygon"]).collect()} == set(np.flatnonzero(parity(*places.T, listed)).tolist())


def test_points_of_nothing(spark):
    edges = spark.createDataFrame([("a", 0.0, 0.0, 9.0, 9.0)], "polygon string, a_lat double, a_lon double, b_lat double, b_lon double")
    points = spark.createDataFrame([(1, 4.0, 1.0), (2, None, 1.0)], "id int, lat double, lon double")
    assert [tuple(r) for r in raster.points_inside(points, edges, ["polygon"]).collect()] == [("a", 1)]
    assert raster.points_inside(points.where("id = 2"), edges, ["polygon"]).count() == 0
    assert raster.points_inside(points, edges.where("polygon = 'b'"), ["polygon"]).count() == 0


def test_raster_of_nothing(spark):
    edges = spark.createDataFrame([], "polygon string, a_lat double, a_lon double, b_lat double, b_lon double")
    assert raster.rasterize(edges, ["polygon"], grids.GridSpec(0.0, 1.0, 0.0, 1.0)).count() == 0


@pytest.mark.parametrize("steps", [1, 8, 45])
def test_blocks_of_noise_equal_the_recursion(spark, steps):
    block, models = 8, [(1, "a", 0.97, -0.2, 2.0), (2, "a", -0.6, 0.5, 1.0), (2, None, 0.0, 0.0, 3.0), (3, "b", 0.5, 0.1, -1.0)]
    df = spark.createDataFrame(models, "month int, id string, phi double, theta double, variance double")
    got = {}
    for r in noise.simulate(df, ["month", "id"], steps, seed=4, block=block).collect():
        got.setdefault((r["month"], r["id"]), {})[r["t"]] = r["noise"]
    for month, name, phi, theta, variance in models:
        eta = np.concatenate([noise._eta(4, (month, name), b, variance, min(block, steps - b * block)) for b in range(-(-steps // block))])
        np.testing.assert_allclose([got[month, name][t] for t in range(steps)], noise.arma_series(eta, phi, theta), rtol=0, atol=1e-10)
        assert len(got[month, name]) == steps


def test_a_long_series_keeps_its_moments(spark):
    df = spark.createDataFrame([(1, 0.6, 0.3, 1.0)], "id int, phi double, theta double, variance double")
    x = np.array([r["noise"] for r in noise.simulate(df, ["id"], 60_000).orderBy("t").collect()])
    assert noise.fit_arma(x[:20_000]) == pytest.approx((0.6, 0.3, 1.0), abs=0.05)
    assert x.var() == pytest.approx(1 + 0.9**2 / (1 - 0.36), rel=0.05)


@pytest.mark.parametrize("length", [12.0, 40.0])
def test_kernels_of_boxes_equal_listed_pairs(monkeypatch, length):
    """A cluster, stations at one place, stations with hardly a neighbour and with none, one without a place."""
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.uniform(0, 900, (400, 2)), rng.normal(500, 3, (200, 2)), [[5e4, 5e4], [5e4 + 5 * length, 5e4], [-7e5, 0], [900 + 6 * length, 450], [np.nan, 1]], np.repeat([[3.0, 3.0]], 5, 0)])
    ids = rng.permutation(len(xy)) * 3
    listed = noise.network(ids, *xy.T, length)
    monkeypatch.setattr(noise, "PAIRS", 500)
    monkeypatch.setattr(noise, "COLUMNS", 1)
    boxes = noise.network(ids, *xy.T, length)
    assert isinstance(listed, noise.Sparse) and isinstance(boxes, noise.Smooth) and (listed.ids == boxes.ids).all()
    x = rng.normal(size=(len(xy), 3))
    assert np.abs(listed @ x - boxes @ x).max() < 1e-8
    for a, b in zip(noise.normalized(listed), noise.normalized(boxes)):
        assert np.abs(a @ x - b @ x).max() < 1e-8 and abs(a.squares() - b.squares()) < 1e-6
        for lam in (0.4, 0.9):
            assert np.abs(noise.solve(a, lam, x) - noise.solve(b, lam, x)).max() < 1e-7
    traces = [noise.chebyshev_traces(noise.normalized(k)[1])[0] for k in (listed, boxes)]
    assert np.abs(traces[0] - traces[1]).max() < 1e-4
