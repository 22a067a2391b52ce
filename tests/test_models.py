import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratocline.operators import linear, noise, selection, sibson


def test_decomposition_rebuilds_its_input():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 50))
    scores, loadings, share, mean = linear.decompose(x)
    assert np.allclose(scores[:, :4] @ loadings[:4] + mean, x, atol=1e-8)
    assert share[:4].sum() > 1 - 1e-12


def test_least_squares_finds_coefficients():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    beta = np.array([2.0, 1, -1, 0.5, 0, 3])
    got, error, _ = linear.ols(x, beta[0] + x @ beta[1:] + 0.1 * rng.normal(size=300))
    assert np.allclose(got, beta, atol=0.05) and error**2 < 0.05


def test_selection_takes_components_that_help():
    rng = np.random.default_rng(2)
    t = 90
    scores = rng.normal(size=(t, 12)) * np.array([9, 4, *[1] * 10])
    share = (scores**2).sum(0) / (scores**2).sum()
    y = np.column_stack([scores[:, 0] + 5 * scores[:, 7] + 0.1 * rng.normal(size=t) for _ in range(6)])
    y[::11, 2] = np.nan
    cal = np.arange(t) < 60
    chosen = linear.select_components(scores, share, y, cal, ~cal)
    assert chosen[0] == 0 and 7 in chosen


def test_split_matches_the_published_years():
    parts = selection.split_years(1875, 1999, 38, 11)
    assert parts["test"] == [1877, 1884, 1890, 1897, 1910, 1921, 1922, 1933, 1958, 1963, 1977]
    assert len(parts["val"]) == 38 and len(parts["cal"]) == 76
    second = {k: [y for y in v if y <= 1949] for k, v in parts.items()}
    assert [len(second[k]) for k in ("cal", "val", "test")] == [44, 23, 8]
    assert selection.flag_bounds(44) == (12, 17)


def test_calibrate_and_predict_recover_a_linear_signal(spark):
    rng = np.random.default_rng(3)
    years, cells = np.arange(1900, 1960), 10
    signal = rng.normal(size=len(years)).cumsum()
    field = pd.DataFrame([(1, int(y), c, float(s * (c + 1) + 0.01 * rng.normal())) for y, s in zip(years, signal) for c in range(cells)], columns=["month", "year", "cell", "value"])
    obs = pd.DataFrame([(1, k, int(y), float(3 + k + 2 * s)) for y, s in zip(years, signal) for k in range(3)], columns=["month", "id", "year", "value"])
    roles = {"cal": [int(y) for y in years[:45]], "val": [int(y) for y in years[45:]]}
    f, o = spark.createDataFrame(field), spark.createDataFrame(obs)
    m = linear.calibrate(o, f, roles)
    assert all(r.r2_train > 0.999 for r in m.collect()) and m.count() == 3
    loadings = linear.loadings_of(linear.pca_model(f.withColumnRenamed("year", "t"), ["month"]), ["month"])
    got = linear.predict(linear.project(f.withColumnRenamed("year", "t"), loadings, ["month"]), m, ["month"]).toPandas().merge(obs.rename(columns={"year": "t", "value": "want"}), on=["month", "id", "t"])
    assert len(got) == len(obs) and np.abs(got["value"] - got["want"]).max() < 0.1


def _run(rng, years=90, cells=6, log=False):
    """A field with a slow rise, and stations that follow it; cells have ids with gaps."""
    t = np.arange(1900, 1900 + years)
    signal, rise = rng.normal(size=years), np.linspace(0, 2, years)
    names = [3 * c + 5 for c in range(cells)]
    x = 6 + signal[:, None] * (np.arange(cells) + 1) / 4 + rise[:, None] + 0.05 * rng.normal(size=(years, cells))
    y = np.column_stack([3 + k + 2 * signal + 0.05 * rng.normal(size=years) for k in range(3)])
    if log:
        y = np.exp(y / 4)
    y[3, 1] = np.nan
    field = pd.DataFrame([(1, int(a), names[c], float(x[i, c])) for i, a in enumerate(t) for c in range(cells)], columns=["month", "year", "cell", "value"])
    obs = pd.DataFrame([(1, k, int(a), float(y[i, k])) for i, a in enumerate(t) for k in range(3) if not np.isnan(y[i, k])], columns=["month", "id", "year", "value"])
    return t, names, x, y, field, obs


def _plain_moving_mean(x, k):
    return np.array([x[max(0, i - k // 2) : i + (k - 1) // 2 + 1].mean(0) for i in range(len(x))])


@pytest.mark.parametrize("log", [False, True])
def test_transient_run_equals_a_plain_loop(spark, log):
    """Calibration on the first years, projection of all of them, against the same definition in arrays."""
    t, names, x, y, field, obs = _run(np.random.default_rng(11), log=log)
    n, k = 60, 30
    cal = t < 1900 + n
    roles = {"cal": t[:40].tolist(), "val": t[40:52].tolist(), "test": t[52:n].tolist()}
    f, o = spark.createDataFrame(field), spark.createDataFrame(obs)
    early = f.where(f.year < 1900 + n)
    models = linear.calibrate(o.where(o.year < 1900 + n), early, roles, log=log).cache()
    loadings = linear.loadings_of(linear.pca_model(early.withColumnRenamed("year", "t"), ["month"]), ["month"])
    places = spark.createDataFrame([(i, names[i + 1]) for i in range(3)], "id long, cell long")
    got = {(r.id, r.t): r.value for r in linear.predict_transient(f.withColumnRenamed("year", "t"), loadings, models, places, ["month"], F.col("t") < 1900 + n, k, log=log).collect()}
    assert len(got) == 3 * len(t)

    g = np.log(x + 1 + x[cal].min(0)) if log else x
    moving = _plain_moving_mean(g, k)
    _, vt, _, _ = linear.decompose(x[cal])
    for m in models.collect():
        s = m.id
        assert (m.offset is None) != log and m.rmse_test is not None
        own = y[cal][:, s]
        linked = np.log(own + m.offset) if log else own
        assert not log or abs(m.offset - (1 + np.nanmin(own))) < 1e-12
        assert abs(m.mu - np.nanmean(linked)) < 1e-9
        scores = (x - moving) @ vt[[c - 1 for c in m.pc]].T
        want = m.beta[0] + scores @ np.array(m.beta[1:]) + m.mu + (moving - g[cal].mean(0))[:, s + 1]
        if log:
            want = np.maximum(np.exp(want + m.sigma2 / 2) - m.offset, 0)
        assert np.allclose([got[s, a] for a in t], want, rtol=1e-8)


def test_residuals_of_stored_models(spark, tmp_path):
    from stratocline.sources import model_tables

    t, _, x, y, field, obs = _run(np.random.default_rng(12), years=60, log=True)
    roles = linear.fallback_roles(t.tolist(), 12, 6)
    assert [len(roles[k]) for k in ("val", "test", "cal")] == [12, 6, 42] and sorted(sum(roles.values(), [])) == t.tolist()
    f, o = spark.createDataFrame(field), spark.createDataFrame(obs)
    pca = linear.pca_model(f.withColumnRenamed("year", "t"), ["month"])
    model_tables.write_models(linear.calibrate(o, f, roles, log=True), str(tmp_path / "pcr"))
    model_tables.write_models(pca, str(tmp_path / "pca"))
    models, pca = (model_tables.read_models(spark, str(tmp_path / n)) for n in ("pcr", "pca"))
    scores = linear.project(f.withColumnRenamed("year", "t"), linear.loadings_of(pca, ["month"]), ["month"])
    rows = linear.residuals(o, scores, models, ["month"], roles["cal"]).toPandas()
    for m in models.collect():
        own = rows[rows["id"] == m.id]["value"]
        assert len(own) == m.n_fit and abs((own**2).mean() - m.sigma2) < 1e-9 * max(1, m.sigma2)
    one = linear.diagnostics(models).collect()
    assert len(one) == 1 and one[0].n_stations == 3 and 0 < one[0].ev_pct <= 100


def test_innovations_equal_those_of_the_fit(spark):
    rng = np.random.default_rng(13)
    xy = rng.uniform(0, 100, size=(12, 2))
    n = rng.normal(size=(30, 12))
    n[rng.random(n.shape) < 0.1] = np.nan
    rows = [(1, s, float(xy[s, 0]), float(xy[s, 1]), i, float(n[i, s])) for i in range(30) for s in range(12) if not np.isnan(n[i, s])]
    df = spark.createDataFrame(rows, "month int, id int, x double, y double, t int, value double")
    model = noise.sem_model(df, ["month"], (40.0,))
    want = noise.fit_sem(n, xy, 40.0)[2]
    got = noise.innovations(df, model, ["month"]).collect()
    assert len(got) == len(rows) and all(abs(want[r.t, r.id] - r.value) < 1e-6 for r in got)


@pytest.mark.parametrize("log", [False, True])
def test_selection_and_fits_from_moments_equal_those_of_arrays(spark, monkeypatch, log):
    """Two months, stations with gaps, one with too few years: chosen components, coefficients and errors by least squares on the years."""
    monkeypatch.setattr(linear, "STATION_BLOCKS", 3)
    rng = np.random.default_rng(21)
    years, cells, stations = np.arange(1900, 1990), 14, 9
    roles = {"cal": years[:55].tolist(), "val": years[55:75].tolist(), "test": years[75:].tolist()}
    field, obs, want = [], [], {}
    for month in (1, 2):
        x = rng.normal(size=(len(years), cells)) * np.linspace(4, 0.5, cells)
        scores, _, share, _ = linear.decompose(x)
        y = 2 * scores[:, [0]] + 3 * scores[:, [5 + month]] + rng.normal(size=(len(years), stations))
        y = np.exp(y / 20) if log else y
        y[rng.random(y.shape) < 0.1] = np.nan
        y[5:, 8] = np.nan
        field += [(month, int(t), c, float(x[i, c])) for i, t in enumerate(years) for c in range(cells)]
        obs += [(month, s, int(t), float(y[i, s])) for i, t in enumerate(years) for s in range(stations) if not np.isnan(y[i, s])]
        y = y[:, :8]
        offset = 1 + np.nanmin(y, 0)
        g = np.log(y + offset) if log else y
        centred = g - np.nanmean(g, 0)
        cal, val = (np.isin(years, roles[k]) for k in ("cal", "val"))
        chosen = linear.select_components(scores, share, centred, cal, val)
        for s in range(8):
            v = ~np.isnan(centred[:, s])
            beta, error, _ = linear.ols(scores[v & cal][:, chosen], centred[v & cal, s])
            res = centred[:, s] - np.column_stack([np.ones(len(years)), scores[:, chosen]]) @ beta
            want[month, s] = ([c + 1 for c in chosen], beta, error, np.sqrt(np.mean(res[v & val] ** 2)), offset[s] if log else None, np.nanmean(g[:, s]))
    o, f = spark.createDataFrame(obs, "month int, id int, year int, value double"), spark.createDataFrame(field, "month int, year int, cell int, value double")
    got = linear.calibrate(o, f, roles, log=log).collect()
    assert {(r.month, r.id) for r in got} == set(want) and len({tuple(r.pc) for r in got}) == 2
    for r in got:
        pc, beta, error, late, offset, mu = want[r.month, r.id]
        assert r.pc == pc and np.allclose(r.beta, beta, atol=1e-9) and abs(r.rmse_train - error) < 1e-9 and abs(r.rmse_val - late) < 1e-9
        assert (r.offset == offset or abs(r.offset - offset) < 1e-12) and abs(r.mu - mu) < 1e-9 and abs(r.sigma2 - error**2) < 1e-9


def test_too_few_years_give_no_models(spark):
    o = spark.createDataFrame([(1, 1, 1900, 1.0)], "month int, id int, year int, value double")
    f = spark.createDataFrame([(1, 1900, 0, 1.0)], "month int, year int, cell int, value double")
    assert linear.calibrate(o, f, {"cal": [1900], "val": []}).count() == 0


def test_minimizer():
    x, fx = noise.minimize_bounded(lambda v: (v - 0.37) ** 2 + 1, 0, 0.9)
    assert abs(x - 0.37) < 1e-5 and abs(fx - 1) < 1e-9


def test_weights_and_inverse():
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 200, size=(60, 2))
    w = noise.dense_weights(xy, 50.0)
    assert np.allclose(w.sum(1), 1 / 1.01)
    e = rng.normal(size=(5, 60))
    u = noise.inverse_sem(e, xy, 0.6, 50.0)
    assert np.allclose(u - 0.6 * u @ w.T, e)


def test_sparse_weights_equal_dense_ones(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 100, size=(30, 2))
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    got = np.zeros((30, 30))
    for r in noise.gaussian_weights(s, 40.0).collect():
        got[r.i, r.j] = r.w
    assert np.allclose(got, noise.dense_weights(xy, 40.0), atol=1e-9)


def test_sparse_weights_with_isolated_stations_equal_dense_ones(spark):
    rng = np.random.default_rng(15)
    xy = np.vstack([rng.uniform(0, 100, size=(20, 2)), [[5e4, 5e4], [-7e5, 0.0]]])
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    got = np.zeros((22, 22))
    for r in noise.gaussian_weights(s, 40.0).collect():
        got[r.i, r.j] = r.w
    assert np.allclose(got, noise.dense_weights(xy, 40.0), atol=1e-9) and (got[20:] == 0).all()


def _sparse(xy, length):
    w = noise.dense_weights(xy, length)
    k = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(-1) / (2 * length * length))
    np.fill_diagonal(k, 0)
    s = k / np.sqrt(np.outer(k.sum(1), k.sum(1)))
    i, j = np.nonzero(w > 1e-12)
    return w, noise.sparse(np.arange(len(xy)), i, j, w[i, j]), s, noise.sparse(np.arange(len(xy)), i, j, s[i, j])


@pytest.mark.parametrize("lam", [0.0, 0.3, 0.9])
def test_sparse_solve_equals_a_dense_one(lam):
    rng = np.random.default_rng(16)
    w, rows, _, _ = _sparse(rng.uniform(0, 300, size=(150, 2)), 40.0)
    e = rng.normal(size=(150, 19))
    e[:, 3] = 0
    want = np.linalg.solve(np.eye(150) - lam * w, e)
    assert np.abs(noise.solve(rows, lam, e) - want).max() < 1e-9


def test_log_determinant_from_traces_is_within_its_error():
    rng = np.random.default_rng(17)
    _, _, s, rows = _sparse(rng.uniform(0, 900, size=(600, 2)), 40.0)
    eig = np.linalg.eigvalsh((s + s.T) / 2)
    traces, error = noise.chebyshev_traces(rows)
    exact = np.array([np.cos(k * np.arccos(np.clip(eig, -1, 1))).sum() for k in range(len(traces))])
    assert np.abs(traces[:3] - exact[:3]).max() < 1e-6 and (np.abs(traces - exact) <= 5 * error + 1e-6).all()
    for lam in (0.2, 0.6, 0.9 / noise.SHRINK):
        want = np.log(np.abs(1 - lam * eig)).sum()
        r = (1 - np.sqrt(1 - lam * lam)) / lam
        bound = 5 * 2 * (r ** np.arange(1, len(error)) / np.arange(1, len(error)) * error[1:]).sum() + 1e-6
        assert abs(noise.log_determinant(exact, lam) - want) < 1e-6
        assert abs(noise.log_determinant(traces, lam) - want) <= bound < 0.05 * abs(want) + 2


def _spatial_rows(spark, n, xy, month=1):
    return spark.createDataFrame([(month, s, float(xy[s, 0]), float(xy[s, 1]), i, float(n[i, s])) for i in range(len(n)) for s in range(len(xy)) if not np.isnan(n[i, s])], "month int, id int, x double, y double, t int, value double")


def test_spatial_fit_by_sums_equals_the_dense_one(spark, monkeypatch):
    monkeypatch.setattr(noise, "BLOCK", 7)
    rng = np.random.default_rng(18)
    xy = rng.uniform(0, 300, size=(80, 2))
    n = noise.inverse_sem(rng.normal(size=(60, 80)), xy, 0.7, 50.0)
    n[rng.random(n.shape) < 0.1] = np.nan
    df = _spatial_rows(spark, n, xy)
    lam, value, _ = noise.fit_sem(n, xy, 50.0)
    got = noise.sem_model(df, ["month"], (50.0,)).first()
    assert abs(got["lambda"] - lam) < 1e-4 and abs(got.objective - value) < 1e-3 and got.n_stations == 80
    monkeypatch.setattr(noise, "DENSE", 10)
    estimated = noise.sem_model(df, ["month"], (50.0,)).first()
    assert abs(estimated["lambda"] - lam) < 0.05


def test_spread_noise_equals_the_dense_solve(spark, monkeypatch):
    monkeypatch.setattr(noise, "BLOCK", 16)
    rng = np.random.default_rng(19)
    xy = rng.uniform(0, 300, size=(40, 2))
    e = rng.normal(size=(50, 40))
    stations = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    rows = spark.createDataFrame([(m, s, i, float(e[i, s])) for m in (1, 2, 3) for i in range(50) for s in range(40)], "month int, id int, t int, noise double")
    models = spark.createDataFrame([(1, 0.8, 50.0), (2, 0.0, 25.0)], "month int, lambda double, length double")
    got = noise.spread_noise(rows, stations, models, ["month"]).collect()
    want = {1: noise.inverse_sem(e, xy, 0.8, 50.0), 2: e}
    assert len(got) == 2 * e.size and max(abs(r.u - want[r.month][r.t, r.id]) for r in got) < 1e-6


def test_weights_of_isolated_stations():
    """A station far from all has no weights; one that hardly has a neighbour has its row sum to 1 before the scale."""
    near = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    w = noise.dense_weights(np.vstack([near, [[1e9, 1e9]]]), 20.0)
    assert (w[3] == 0).all() and (w[:, 3] == 0).all() and np.allclose(w[:3].sum(1), w[0].sum())
    w = noise.dense_weights(np.vstack([near, [[200.0, 0.0]]]), 20.0)
    assert np.allclose(w.sum(1), 1 / 1.01)


def test_arma_fit_near_the_edge():
    x = noise.arma_series(np.random.default_rng(9).normal(size=3000), 0.97, -0.2)
    phi, theta, _ = noise.fit_arma(x)
    low, high = max(0.95 - noise.REACH, -noise.EDGE), min(0.95 + noise.REACH, noise.EDGE)
    steps = (phi - low) / (high - low) * (noise.FINE - 1)
    assert abs(phi - 0.97) < 0.02 and abs(steps - round(steps)) < 1e-6


def test_spatial_fit_finds_lambda():
    rng = np.random.default_rng(6)
    xy = rng.uniform(0, 300, size=(80, 2))
    n = noise.inverse_sem(rng.normal(size=(120, 80)), xy, 0.7, 50.0)
    lam, _, _ = noise.fit_sem(n, xy, 50.0)
    assert abs(lam - 0.7) < 0.1


def test_arma_fit_and_series():
    rng = np.random.default_rng(7)
    x = noise.arma_series(rng.normal(size=4000), 0.6, 0.3)
    phi, theta, var = noise.fit_arma(x)
    assert abs(phi - 0.6) < 0.1 and abs(theta - 0.3) < 0.1 and abs(var - 1) < 0.1
    assert noise.fit_arma(np.arange(5.0))[:2] == (0.0, 0.0)


def test_natural_neighbours_reproduce_planes():
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 1e6, size=(300, 2))
    corners = sibson.hull(xy)
    for q in rng.uniform(3e5, 7e5, size=(25, 2)):
        i, w = sibson.weights_at(q, xy, corners)
        assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
        assert np.abs(w @ xy[i] - q).max() < 1e-4
    i, w = sibson.weights_at(np.array([-5e6, 0.0]), xy, corners)
    assert len(i) == 1 and i[0] == ((xy - [-5e6, 0]) ** 2).sum(1).argmin()
    i, w = sibson.weights_at(xy[5], xy, corners)
    assert list(i) == [5]


def test_monte_carlo_interval_is_repeatable(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id int, value double")
    a = linear.monte_carlo_interval(df, ["id"], F.lit(1.0), 500).orderBy("id").collect()
    b = linear.monte_carlo_interval(df.repartition(3), ["id"], F.lit(1.0), 500).orderBy("id").collect()
    assert a == b and all(1.5 < r.pi_hi - r.value < 2.6 and 1.5 < r.value - r.pi_lo < 2.6 for r in a)


def test_monte_carlo_draws_are_those_of_the_hashes_of_the_keys(spark):
    """The expression that states the draws, ranked by Spark; null values and variances stay null."""
    keys, draws = ["id", "name"], 40
    df = spark.createDataFrame([(i, f"n{i % 3}", float(i) if i % 7 else None, i / 3 if i % 5 else None) for i in range(60)], "id int, name string, value double, mse double")

    def uniform(n, i):
        return (F.pmod(F.xxhash64(*keys, n, F.lit(9), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    z = F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda n: F.sqrt(-2 * F.ln(uniform(n, 1))) * F.cos(2 * np.pi * uniform(n, 2))))
    want = {r.id: (r.value, r.mse, np.quantile(r.z, [0.025, 0.975])) for r in df.select("*", z.alias("z")).collect()}
    plan = linear.monte_carlo_interval(df, keys, F.col("mse"), draws, 9)
    assert "MapInArrow" in plan._jdf.queryExecution().toString()  # not draw by draw in an expression
    got = plan.collect()
    assert len(got) == len(want)
    for r in got:
        value, mse, q = want[r.id]
        if value is None or mse is None:
            assert r.pi_lo is None and r.pi_hi is None and r.value == value
        else:
            assert np.allclose([r.pi_lo, r.pi_hi], value + mse**0.5 * q, atol=1e-9)


def test_grids_and_intervals_cover_all_months(spark):
    from stratocline.plans import models
    from stratocline.plans import views as V

    d = "/root/testdata/sf0.001"
    o = V.obs(spark, d)
    months = {r.year * 12 + r.month for r in o.select("year", "month").distinct().collect()}
    assert {r.t for r in models.q_sibson_grid(spark, d).select("t").distinct().collect()} == months
    keys = ["id", "year", "month"]
    assert sorted(models.q_mc_pi(spark, d).select(keys).collect()) == sorted(o.select(keys).collect())


def test_gaps_take_the_neighbours_that_report(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 100, size=(60, 2))
    stations = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    cells = [(c, float(x), float(y)) for c, (x, y) in enumerate(rng.uniform(30, 70, size=(20, 2)))] + [(99, -50.0, -50.0)]
    # time 2 has the gaps of time 1, time 3 has no station near the corner of cell 99
    gone = {0: set(), 1: set(range(0, 60, 3)), 2: set(range(0, 60, 3)), 3: set(np.argsort(((xy + 50) ** 2).sum(1))[:5].tolist())}
    plane = 2 * xy[:, 0] - xy[:, 1]
    rows = [(i, t, float(plane[i]) if i not in gone[t] else None) for t in gone for i in range(60)] + [(77, 0, 1e9)]
    got = {(r.cell, r.t): r.value for r in sibson.interpolate_reported(spark.createDataFrame(rows, "id int, t int, value double"), spark.createDataFrame(cells, "cell int, x double, y double"), stations).collect()}
    assert len(got) == len(cells) * len(gone)
    for t, missing in gone.items():
        for c, x, y in cells[:-1]:
            assert abs(got[c, t] - (2 * x - y)) < 1e-6
        near = min(set(range(60)) - missing, key=lambda i: ((xy[i] + 50) ** 2).sum())
        assert abs(got[99, t] - plane[near]) < 1e-9


def test_long_fields_have_the_same_components(spark, monkeypatch):
    """Products summed over tasks give the components of the whole matrix: long and wide groups, gaps, null keys."""
    monkeypatch.setattr(linear, "STRIP", 7)
    rng = np.random.default_rng(12)
    rows = []
    for key, n, cells in (("long", 700, 12), (None, 40, 70), ("one", 1, 5), ("flat", 9, 3), ("gap", 50, 6)):
        x = rng.normal(size=(n, 4)) * [9, 5, 3, 1] @ rng.normal(size=(4, cells)) + rng.normal(size=(n, cells)) * 0.1 + 100 * np.arange(cells)
        x = np.ones_like(x) if key == "flat" else x
        for t in range(n):
            for c in range(cells):
                v = None if key == "gap" and (c, t) == (1, 3) else float("nan") if key == "gap" and (c, t) == (4, 7) else float(x[t, c])
                if (key, c, t) != ("gap", 2, 9):
                    rows.append((key, t, c, v))
    field = spark.createDataFrame(rows, "key string, t int, cell int, value double").repartition(7)
    got = {(r["key"], r["pc"]): r for r in linear.pca_long(field, ["key"], 30).collect()}
    want = {(r["key"], r["pc"]): r for r in linear.pca_model(field, ["key"], 30).collect()}
    assert set(got) == set(want) and {k for k, _ in got} == {"long", None, "flat", "gap"} and got["gap", 1]["cell"] == [0, 3, 5]
    for k, w in want.items():
        g = got[k]
        assert g["cell"] == w["cell"] and np.allclose(g["mean"], w["mean"], rtol=1e-12) and abs(g["share"] - w["share"]) < 1e-12
        if k[1] <= 4 and k[0] in ("long", None):
            assert np.allclose(g["loading"], w["loading"], atol=1e-8)
    assert linear.pca_long(field.where("key = 'none'"), ["key"]).count() == 0


def test_fits_are_made_row_by_row_from_the_join_on(spark):
    """Nothing of a station and a time is summed over rows; scores that are null or missing are left out, a time without any chosen one too."""
    scores = spark.createDataFrame([(1, 5, 1, 2.0), (1, 5, 2, None), (1, 5, 3, 4.0), (1, 6, 2, None), (1, 7, 9, 1.0)], "month int, t int, pc int, score double")
    models = spark.createDataFrame([(1, 10, [3, 2, 1], [0.5, 1.0, 10.0, 100.0]), (1, 11, [2], [0.5, 1.0]), (2, 12, [1], [0.5, 1.0])], "month int, id int, pc array<int>, beta array<double>")
    made = linear.fitted(scores, models, ["month"])
    assert {(r.id, r.t): r.fit for r in made.collect()} == {(10, 5): 204.5, (10, 6): None, (11, 5): None, (11, 6): None}
    assert "sum(" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("tile, few, text", [(7, 512, False), (5, 0, True), (2048, 512, False)])
def test_weights_of_packed_rows_equal_plain_loops(spark, monkeypatch, tile, few, text):
    monkeypatch.setattr(noise, "TILE", tile)
    monkeypatch.setattr(noise, "FEW", few)
    rng = np.random.default_rng(23)
    # two crowds, lattice points at exactly the reach, ids that stand twice, stations without a place
    xy = np.vstack([rng.normal(0, 3, (40, 2)), rng.normal((70, -50), 9, (40, 2)), [(18.0 * a, 24.0 * b) for a in range(-2, 3) for b in range(-2, 3)], [(400.0, 400.0)]])
    rows = [(str(n % 97) if text else n % 97, float(x), float(y)) for n, (x, y) in enumerate(xy)]
    kind = "string" if text else "bigint"
    s = spark.createDataFrame([*rows, (None, 1.0, 1.0), (rows[3][0], None, 2.0), (rows[4][0], 2.0, float("nan"))], f"id {kind}, x double, y double")
    pairs = [(i, j, math.exp(-((x - u) ** 2 + (y - v) ** 2) / 50)) for i, x, y in rows for j, u, v in rows if i != j and (x - u) ** 2 + (y - v) ** 2 <= 900]
    total = {}
    for i, _, k in pairs:
        total[i] = total.get(i, 0.0) + k
    got = noise.gaussian_weights(s, 5.0, 6.0)
    assert dict(got.dtypes) == {"i": kind, "j": kind, "w": "double"}
    got = sorted(tuple(r) for r in got.collect())
    want = sorted((i, j, k / total[i] / 1.01) for i, j, k in pairs)
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-12, atol=0)
    # two networks with lengths of their own
    two = s.withColumn("net", F.lit("a")).union(s.withColumn("net", F.lit("b")))
    made = noise.kernel(two, ["net"], F.when(F.col("net") == "a", 5.0).otherwise(2.5), 6.0).collect()
    for net, h in (("a", 5.0), ("b", 2.5)):
        one = sorted((i, j, math.exp(-((x - u) ** 2 + (y - v) ** 2) / (2 * h * h))) for i, x, y in rows for j, u, v in rows if i != j and (x - u) ** 2 + (y - v) ** 2 <= (6 * h) ** 2)
        own = sorted((r.i, r.j, r.k) for r in made if r.net == net)
        assert [r[:2] for r in own] == [r[:2] for r in one] and np.allclose([r[2] for r in own], [r[2] for r in one], rtol=1e-12, atol=0)


def test_pairs_of_weights_cross_no_shuffle(spark):
    """What makes the pairs is the last step: no window, sort or exchange of theirs comes after it."""
    s = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(200)], "id int, x double, y double")
    plan = noise.gaussian_weights(s, 5.0, 6.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and "Window" not in plan


def test_scattered_stations_are_packed_together(spark):
    rng = np.random.default_rng(24)
    xy = rng.uniform(-400, 400, size=(500, 2))
    s = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(xy)], "id int, x double, y double")
    rows = noise._known(s, [], F.lit(5.0))
    wide = noise._wide(rows, [], 6.0)
    assert wide > 10 and noise._packed(rows, [], 6.0, wide).count() < 20
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    want = {(i, j): math.exp(-d2[i, j] / 50) for i, j in zip(*np.nonzero((d2 <= 900) & ~np.eye(500, dtype=bool)))}
    got = {(r.i, r.j): r.k for r in noise.kernel(s, [], F.lit(5.0), 6.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_networks_without_neighbours_have_no_weights(spark):
    none = spark.createDataFrame([], "id int, x double, y double")
    far = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e4, 0.0)], "id int, x double, y double")
    assert [noise.gaussian_weights(s, 5.0).count() for s in (none, far)] == [0, 0]
