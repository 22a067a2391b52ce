"""Queries whose results are fits or draws, held against closed forms by tests, and those on given models, which SQL states."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratocline.functions.scalars import albers, normal_interval
from stratocline.operators import grids, linear, noise, sibson
from stratocline.operators.steps import shared_folder, written
from stratocline.plans import views as V
from stratocline.plans.basic import SMALL_GRID, SQL_AXES, SQL_NEAR, query, r
from stratocline.sources.archive import load_archive, write_archive
from stratocline.sources.model_tables import ModelStore

# the tables span seven years: every third month of all years together stands for one
# calendar month, and each of its months for a year, so that groups have the length that fits need
_INDEX = {y: [y * 12 + m for m in range(1, 13)] for y in range(1990, 2010)}
ROLES = {"val": _INDEX[1996] + _INDEX[1998][:6], "test": _INDEX[1998][6:], "cal": [i for y in _INDEX if y not in (1996, 1998) for i in _INDEX[y]]}


def _as_years(df):
    return df.withColumn("year", F.col("year") * 12 + F.col("month")).withColumn("month", F.col("month") % 3 + 1)


def _field(spark, d):
    return _as_years(V.esm(spark, d)).select("month", "year", "cell", "value")


def _models(spark, d, log=False):
    return written(_fits(spark, d, log))


def _fits(spark, d, log=False):
    return linear.calibrate(_as_years(V.obs(spark, d)), written(_field(spark, d)), ROLES, log=log, min_years=25, min_fit=15)


def _scores(spark, d):
    """Scores of the calibration field on the components that the models are fitted on."""
    field = written(_field(spark, d)).withColumnRenamed("year", "t")
    return written(linear.project(field, linear.loadings_of(linear.pca_model(field, ["month"]), ["month"]), ["month"]))


@query("SELECT CAST(i AS INT) AS dim, round(var_samp(v), 6) AS variance FROM (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY i")
def q_embedding_variance(spark, d):
    rows = V.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy((F.col("i") + 1).alias("dim")).agg(r(F.var_samp(F.col("v").cast("double")), 6).alias("variance"))


@query()
def q_pca_explained(spark, d):
    """Share of variance of the first ten components of the embeddings, by label."""
    rows = V.table(spark, d, "embeddings").select("label", F.col("vec_id").alias("t"), F.posexplode("embedding").alias("cell", "value"))
    return linear.pca_long(rows, ["label"], 10).select("label", "pc", r("share", 6).alias("share"))


@query()
def q_calibrate(spark, d):
    """Station models per month."""
    return _models(spark, d).select("month", "id", F.size("pc").alias("n_pc"), "n_fit", r("rmse_train", 3).alias("rmse_train"), r("r2_train").alias("r2_train"), r("sigma2", 2).alias("sigma2"))


@query()
def q_stepwise(spark, d):
    """How often each component was chosen, by month."""
    m = _models(spark, d)
    return m.select("month", F.explode("pc").alias("pc")).groupBy("month", "pc").agg(F.count(F.lit(1)).alias("stations"))


@query()
def q_calibrate_log(spark, d):
    """Station models through the log link, with their offsets and validation and test errors."""
    m = _models(spark, d, log=True)
    return m.select("month", "id", r("offset", 2).alias("offset"), r("mu").alias("mu"), r("rmse_val").alias("rmse_val"), r("rmse_test").alias("rmse_test"), r("sigma2", 6).alias("sigma2"))


@query()
def q_calibration_diagnostics(spark, d):
    """Stations, components, variance held and median errors by month."""
    return linear.diagnostics(_models(spark, d)).select("month", "n_stations", "n_pc", r("ev_pct", 3).alias("ev_pct"), r("rmse_train", 3).alias("rmse_train"), r("rmse_test", 3).alias("rmse_test"), r("r2_train").alias("r2_train"))


@query()
def q_model_residuals(spark, d):
    """Observations of the calibration years less what the models fit."""
    return _residuals(spark, d).select("month", "id", "t", r("value", 3).alias("value"))


@query()
def q_predict(spark, d):
    """Projection, coefficients and 95 % bounds of all station models."""
    models = _models(spark, d)
    out = linear.predict(_scores(spark, d), models, ["month"]).join(models.select("month", "id", "sigma2"), ["month", "id"])
    lo, hi = normal_interval(F.col("value"), F.col("sigma2"))
    return out.select("id", F.col("t").alias("year"), "month", r("value", 3).alias("value"), r(lo, 3).alias("pi_lo"), r(hi, 3).alias("pi_hi"))


def _fixed_models(spark, d, log):
    """Models given by formulas, so that SQL can state the projection: two components, coefficients by station."""
    k = F.col("id")
    beta = F.array(F.lit(0.5), *[((k * i) % 5 - 2) / 100.0 for i in (1, 2)])
    offset = (1 + k % 3).cast("double") if log else F.lit(None).cast("double")
    rows = V.meta(spark, d).select("id", (2 + (k % 7) / 10.0).alias("mu"), beta.alias("beta"), F.array(F.lit(1), F.lit(2)).alias("pc"), F.lit(0.04).alias("sigma2"), offset.alias("offset"))
    return rows.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def _transient(spark, d, log):
    field = V.esm(spark, d).withColumnRenamed("year", "t")
    weights = field.select("month", "cell").distinct().withColumn("pc", F.explode(F.array(F.lit(1), F.lit(2))))
    weights = weights.withColumn("weight", ((F.col("cell") * (F.col("pc") + 3)) % 11 - 5) / 100.0)
    lat, lon = (grids.nearest_index(F.col(c), axis) for c, axis in (("lat", V.LAT_AXIS), ("lon", V.LON_AXIS)))
    places = V.meta(spark, d).select("id", (lat * len(V.LON_AXIS) + lon).alias("cell"))
    out = linear.predict_transient(field, weights, _fixed_models(spark, d, log), places, ["month"], F.col("t") <= 1998, log=log)
    return out.select("id", F.col("t").alias("year"), "month", r("value").alias("value"))


def _transient_sql(g: str, back: str) -> str:
    frame = "PARTITION BY cell, month ORDER BY year ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING"
    return (
        f"WITH {V.SQL_META}, {V.SQL_ESM}, {SQL_AXES}, {SQL_NEAR}, l AS (SELECT *, {g} AS g FROM esm), "
        f"m AS (SELECT year, month, cell, value - avg(g) OVER ({frame}) AS a, avg(g) OVER ({frame}) - avg(CASE WHEN year <= 1998 THEN g END) OVER (PARTITION BY cell, month) AS shift FROM l), "
        "s AS (SELECT year, month, sum(a * ((cell * 4) % 11 - 5) / 100.0::DOUBLE) AS s1, sum(a * ((cell * 5) % 11 - 5) / 100.0::DOUBLE) AS s2 FROM m GROUP BY year, month), "
        "p AS (SELECT n.id, s.year, s.month, 0.5::DOUBLE + s1 * (n.id % 5 - 2) / 100.0::DOUBLE + s2 * ((n.id * 2) % 5 - 2) / 100.0::DOUBLE + 2 + (n.id % 7) / 10.0::DOUBLE + m.shift AS g "
        "FROM near n CROSS JOIN s LEFT JOIN m ON m.cell = n.lat_idx * 12 + n.lon_idx AND m.year = s.year AND m.month = s.month) "
        f"SELECT id, year, month, round({back}, 4) AS value FROM p"
    )


@query(_transient_sql("value", "g"))
def q_predict_transient(spark, d):
    """A whole run through given models: scores of the field less its moving mean, the model's slow change at the nearest cell."""
    return _transient(spark, d, False)


@query(_transient_sql("ln(value + 1 + min(CASE WHEN year <= 1998 THEN value END) OVER (PARTITION BY cell, month))", "CASE WHEN exp(g + 0.04::DOUBLE / 2) < 1 + id % 3 THEN 0 ELSE exp(g + 0.04::DOUBLE / 2) - (1 + id % 3) END"))
def q_predict_transient_log(spark, d):
    """The same through the log link and back."""
    return _transient(spark, d, True)


def _places(spark, d):
    x, y = albers(F.col("lat"), F.col("lon"))
    return V.meta(spark, d).select("id", (x / 1000).alias("x"), (y / 1000).alias("y"))


def _cells(spark):
    x, y = albers(F.col("lat"), F.col("lon"))
    return SMALL_GRID.cells(spark).select("cell", (x / 1000).alias("x"), (y / 1000).alias("y"))


@query()
def q_sibson_weights(spark, d):
    return sibson.sibson_weights(_cells(spark), _places(spark, d)).select("cell", "id", r("w", 6).alias("w"))


@query("SELECT CAST(unnest(range(91)) AS BIGINT) AS cell, TRUE AS sums_to_one")
def q_sibson_closure(spark, d):
    """Weights of each cell sum to one."""
    w = sibson.sibson_weights(_cells(spark), _places(spark, d))
    return w.groupBy("cell").agg((F.abs(F.sum("w") - 1) < 1e-9).alias("sums_to_one"))


@query()
def q_sibson_grid(spark, d):
    """Monthly values on the grid: one set of weights per set of reporting stations, then a join and a sum."""
    v = V.obs(spark, d).select("id", (F.col("year") * 12 + F.col("month")).alias("t"), "value")
    return sibson.interpolate_reported(v, _cells(spark), _places(spark, d)).select("cell", "t", r("value", 3).alias("value"))


@query()
def q_station_sets(spark, d):
    v = V.obs_with_gaps(spark, d).select("id", (F.col("year") * 12 + F.col("month")).alias("t"), "value")
    return sibson.station_sets(v).select("t", "n")


def _residuals(spark, d, scores=None, models=None):
    """Residuals (month, id, t, value) of the station models in the calibration years."""
    return linear.residuals(_as_years(V.obs(spark, d)), scores or _scores(spark, d), models or _models(spark, d), ["month"], ROLES["cal"], 15)


def _placed_residuals(spark, d, scores=None, models=None):
    return written(_residuals(spark, d, scores, models).withColumn("value", F.col("value") / 1000).join(_places(spark, d), "id"))


@query()
def q_sem_fit(spark, d):
    """Spatial dependence of the residuals of the station models, by month."""
    return noise.sem_model(_placed_residuals(spark, d), ["month"], (250.0, 500.0, 1000.0)).select("month", r("lambda").alias("lambda"), "length", r("objective", 3).alias("objective"), "n_stations")


@query()
def q_arma_fit(spark, d):
    """Serial dependence of what the spatial model leaves, by month and station."""
    rows = _placed_residuals(spark, d)
    left = noise.innovations(rows, written(noise.sem_model(rows, ["month"], (500.0,))), ["month"])
    return noise.arma_model(left, ["month", "id"]).select("month", "id", r("phi").alias("phi"), r("theta").alias("theta"), r("variance", 6).alias("variance"))


@query()
def q_noise_realization(spark, d):
    """Predictions with a seeded realization of each station's noise, spread in space."""
    scores, models = _scores(spark, d), _models(spark, d)
    rows = _placed_residuals(spark, d, scores, models)
    sem = written(noise.sem_model(rows, ["month"], (500.0,)))
    arma = noise.arma_model(noise.innovations(rows, sem, ["month"]), ["month", "id"])
    base = linear.predict(scores, models, ["month"]).withColumnRenamed("t", "year")
    # pseudo-years follow each other by three: steps of the series from the first one on
    base = base.withColumn("t", F.floor((F.col("year") - 1990 * 12) / 3).cast("int"))
    u = noise.spread_noise(noise.simulate(arma, ["month", "id"], 80), _places(spark, d), sem, ["month"])
    out = noise.realization(base.join(u.withColumn("u", F.col("u") * 1000), ["month", "id", "t"]), "tas", ["id", "month"])
    return out.select("id", "year", "month", r("value_real", 3).alias("value_real"))


@query()
def q_mc_pi(spark, d):
    o = V.obs(spark, d, "l_quantity")
    return linear.monte_carlo_interval(o, ["id", "year", "month"], F.lit(4.0)).select("id", "year", "month", r("value", 3).alias("value"), r("pi_lo", 3).alias("pi_lo"), r("pi_hi", 3).alias("pi_hi"))


@query()
def q_idw_grid(spark, d):
    mean = V.obs(spark, d).groupBy("id").agg(F.avg("value").alias("value"))
    return sibson.inverse_distance(_cells(spark), _places(spark, d).join(mean, "id")).select("cell", r("value", 3).alias("value"))


def _store(spark):
    name = f"models_{uuid.uuid4().hex}"
    return ModelStore(spark, name, f"{shared_folder(spark)}/{name}", buckets=16)


@query(f"""WITH {V.SQL_OBSQ}, m AS (SELECT id, month, min(value) AS low, count(*) AS n FROM obs GROUP BY id, month)
SELECT o.id, o.year, o.month, m.n, round(o.value - m.low - 2, 4) AS residual FROM obs o JOIN m USING (id, month)""")
def q_stored_models(spark, d):
    """Residuals from the second version of a stored table of models, replaced once: the models are joined as they lie in their buckets."""
    o, store = V.obs(spark, d, "l_quantity"), _store(spark)
    models = o.groupBy("month", "id").agg(F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))
    for version, shift in (("first", 0), ("second", 1), ("second", 2)):
        store.save(models.withColumn("low", F.col("low") + shift), version, {"observations": "lineitem", "shift": str(shift)})
    joined = o.join(store.read("second"), ["month", "id"])
    return joined.select("id", "year", "month", "n", r(F.col("value") - F.col("low")).alias("residual"))


@query()
def q_predict_stored(spark, d):
    """Predictions of fitted models that were written as a version of a store and read back."""
    store = _store(spark)
    store.save(_fits(spark, d), "fitted", {"observations": "lineitem", "field": "lineitem"})
    return linear.predict(_scores(spark, d), store.read("fitted"), ["month"]).select("id", F.col("t").alias("year"), "month", r("value").alias("value"))


_TENTHS = "CAST(round_even(value * 10.0::DOUBLE, 0) AS BIGINT)"


@query(f"""WITH {V.SQL_OBSQ}, {V.SQL_META} SELECT 'S' || o.id AS id, o.year, o.month, round(m.lat, 2) AS lat, round(m.lon, 2) AS lon,
round({_TENTHS} / 10.0::DOUBLE / day(last_day(make_date(o.year, o.month, 1))), 6) AS value FROM obs o JOIN meta m ON m.id = o.id WHERE m.lat BETWEEN 25 AND 65 AND m.lon BETWEEN -145 AND -65 AND o.year BETWEEN 1993 AND 1996""")
def q_station_archive(spark, d):
    """Observations as files of an archive, a station each, read back in a box: other stations' files are left after a record."""
    rows = V.obs(spark, d, "l_quantity").join(V.meta(spark, d), "id").withColumn("id", F.concat(F.lit("S"), F.col("id")))
    flags = [F.lit(None).cast("string").alias(c) for c in ("mflag", "qflag", "sflag", "src")]
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(rows.select("id", F.col("id").alias("name"), "lat", "lon", F.lit(0.0).alias("elev"), (F.col("year") * 100 + F.col("month")).alias("yyyymm"), F.rint(F.col("value") * 10).cast("long").alias("raw"), *flags), folder)
    read = load_archive(spark, folder, (25.0, 65.0), (-145.0, -65.0), 1993, 1996)
    return read.select("id", "year", "month", r("lat", 2).alias("lat"), r("lon", 2).alias("lon"), r("value", 6).alias("value"))
