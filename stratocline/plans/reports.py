"""Report tables in full: variance correction, bias by source, split by station and year, windows with intervals, bounds over years."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratocline.functions import metrics as M
from stratocline.functions import scalars as S
from stratocline.operators import comparison, grids, moving, selection
from stratocline.operators.steps import shared_folder
from stratocline.plans import basic
from stratocline.plans import views as V
from stratocline.plans.basic import query, r
from stratocline.sources import fields

_TEST_ROWS = f"year IN {V.TEST_YEARS}"
_BIASES = ("mean", "p10", "p90")


def _shares(c: str):
    return {"mean": F.avg(c), "p10": F.percentile(c, 0.1), "p90": F.percentile(c, 0.9)}


def _biases(rows, sources: dict[str, str]):
    """(id, source, metric, bias): mean, tenth and ninetieth percentile of each source less those of the observations ``o``; sources share a pass."""
    columns = {**sources, "o": "o"}
    wide = rows.groupBy("id").agg(*[e.alias(f"{c}_{m}") for c in columns for m, e in _shares(c).items()])
    long = F.inline(F.array(*[F.struct(F.lit(label).alias("source"), F.lit(m).alias("metric"), (F.col(f"{c}_{m}") - F.col(f"o_{m}")).alias("bias")) for c, label in sources.items() for m in _BIASES]))
    return wide.select("id", long)


def _biases_sql(rows: str, sources: dict[str, str]) -> str:
    at = {"mean": "avg({})", "p10": "quantile_cont({}, 0.1)", "p90": "quantile_cont({}, 0.9)"}
    return " UNION ALL ".join(f"SELECT id, '{label}' AS source, '{m}' AS metric, {f.format(c)} - {f.format('o')} AS bias FROM {rows} GROUP BY id" for c, label in sources.items() for m, f in at.items())


_VC = f"""m AS (SELECT *, avg(p) OVER w AS mp, avg(e) OVER w AS me FROM pairs WINDOW w AS ({basic._W30})), a AS (SELECT *, p - mp AS ap, e - me AS ae FROM m),
s AS (SELECT *, CASE WHEN count(ap) OVER w = 1 THEN 0.0 ELSE stddev_samp(ap) OVER w END AS sp, CASE WHEN count(ae) OVER w = 1 THEN 0.0 ELSE stddev_samp(ae) OVER w END AS se FROM a WINDOW w AS ({basic._W30})),
vc AS (SELECT id, year, month, o, p, mp + ap * coalesce(se / nullif(sp, 0), 1.0) AS c FROM s), t AS (SELECT * FROM vc WHERE {_TEST_ROWS})"""


@query(f"WITH {V.SQL_PAIRS}, {_VC}, b AS ({_biases_sql('t', {'p': 'raw', 'c': 'corrected'})}) SELECT source, metric, count(*) AS stations, round(median(bias), 3) AS median, round(avg(abs(bias)), 3) AS mae, round(sqrt(avg(bias * bias)), 3) AS rmse FROM b GROUP BY source, metric")
def q_vc_report(spark, d):
    """Biases in the test years before and after variance correction, which sees all years."""
    corrected = moving.variance_correction(V.pairs(spark, d), ["id"], ["year", "month"], "p", "e", 30, "c")
    b = _biases(corrected.where(F.col("year").isin(*V.TEST_YEARS)), {"p": "raw", "c": "corrected"})
    x = F.col("bias")
    return b.groupBy("source", "metric").agg(F.count(F.lit(1)).alias("stations"), r(F.median(x), 3).alias("median"), r(F.avg(F.abs(x)), 3).alias("mae"), r(F.sqrt(F.avg(x * x)), 3).alias("rmse"))


@query(f"WITH {V.SQL_PAIRS}, t AS (SELECT * FROM pairs WHERE {_TEST_ROWS}), b AS ({_biases_sql('t', {'p': 'regression', 'e': 'model'})}) SELECT id, source, metric, round(bias, 3) AS bias FROM b")
def q_bias_maps(spark, d):
    """The regression's and the model's biases against the observations, by station."""
    rows = V.pairs(spark, d).where(F.col("year").isin(*V.TEST_YEARS))
    return _biases(rows, {"p": "regression", "e": "model"}).select("id", "source", "metric", r("bias", 3).alias("bias"))


@query(f"""WITH {basic._FLAG_BASE}, kept AS (SELECT id, flag FROM flagged WHERE flag <> 'removed'), y AS (SELECT DISTINCT year FROM obs), h AS (SELECT DISTINCT id, year FROM obs WHERE value IS NOT NULL)
SELECT k.id, y.year, CAST(CASE WHEN h.id IS NULL THEN 0 WHEN flag = 'test_only' THEN 3 WHEN y.{_TEST_ROWS} THEN 3 WHEN y.year = {V.VAL_YEARS[0]} THEN 2 ELSE 1 END AS INT) AS code FROM kept k CROSS JOIN y LEFT JOIN h ON h.id = k.id AND h.year = y.year""")
def q_split_codes(spark, d):
    """Each kept station in each year: 0 without values, 1 calibration, 2 validation, 3 test."""
    o, flags = basic._flags(spark, d)
    role = selection.year_role(F.col("year"), {"test": list(V.TEST_YEARS), "val": list(V.VAL_YEARS)})
    label = selection.split_label(role, F.col("flag"))
    # years are a list of some hundred, repeated beside each station
    years = o.agg(F.array_sort(F.collect_set("year")).alias("years"))
    dense = flags.where("flag <> 'removed'").crossJoin(F.broadcast(years)).select("id", "flag", F.explode("years").alias("year"))
    has = o.where("value IS NOT NULL").select("id", "year").distinct().withColumn("has", F.lit(True))
    code = F.when(F.col("has").isNull(), 0).when(label == "test", 3).when(label == "val", 2).otherwise(1)
    return dense.join(has, ["id", "year"], "left").select("id", "year", code.alias("code"))


_WINDOW = "CASE WHEN year <= 1996 THEN 'a' WHEN year <= 1998 THEN 'b' ELSE 'c' END"
_CELL_SPREAD = f"spread AS (SELECT CAST(l_partkey % 96 AS INT) AS cell, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, {V.sql_mean('l_quantity')} AS value, {V.sql_mean('l_quantity * l_quantity')} AS square FROM lineitem GROUP BY ALL)"
_INTERVAL = f"{_CELL_SPREAD}, i AS (SELECT cell, year, month, value, value - 1.96 * sqrt(greatest(square - value * value, 0)) AS pi_lo, value + 1.96 * sqrt(greatest(square - value * value, 0)) AS pi_hi FROM spread)"


def _intervals(spark, d):
    """Cell months with an interval from the spread of their rows."""
    rows = V.table(spark, d, "lineitem").select((F.col("l_partkey") % 96).cast("int").alias("cell"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("q"))
    s = rows.groupBy("cell", "year", "month").agg(M.exact_mean(F.col("q")).alias("value"), M.exact_mean(F.col("q") * F.col("q")).alias("square"))
    lo, hi = S.normal_interval(F.col("value"), F.greatest(F.col("square") - F.col("value") * F.col("value"), F.lit(0.0)))
    return s.select("cell", "year", "month", "value", lo.alias("pi_lo"), hi.alias("pi_hi"))


@query(f"""WITH {_INTERVAL}, w AS (SELECT cell, {_WINDOW} AS win, {V.sql_mean('value', 9)} AS m, {V.sql_mean('(pi_hi - pi_lo)', 9)} AS width FROM i GROUP BY ALL),
x AS (SELECT *, m - {V.sql_mean('m', 9, 'OVER (PARTITION BY cell)')} AS a, (cell // 12 * 31 + cell % 12 * 17) % 5 <> 0 AS land FROM w)
SELECT cell, win, CASE WHEN land THEN round(m, 4) END AS mean, CASE WHEN land THEN round(width, 4) END AS width, CASE WHEN land THEN round(a, 4) END AS anomaly FROM x""")
def q_window_maps(spark, d):
    """Mean, width of the interval and anomaly of each cell and window; null at sea."""
    win = F.when(F.col("year") <= 1996, "a").when(F.col("year") <= 1998, "b").otherwise("c")
    m = _intervals(spark, d).groupBy("cell", win.alias("win")).agg(M.exact_mean(F.col("value"), 9).alias("mean"), M.exact_mean(F.col("pi_hi") - F.col("pi_lo"), 9).alias("width"))
    m = moving.anomaly(m, ["cell"], "mean", "anomaly", 9).withColumn("lat_idx", F.floor(F.col("cell") / 12).cast("int")).withColumn("lon_idx", F.col("cell") % 12)
    mask = m.select("lat_idx", "lon_idx").distinct().withColumn("is_land", (F.col("lat_idx") * 31 + F.col("lon_idx") * 17) % 5 != 0)
    packed = grids.masked(m.withColumn("value", F.struct("mean", "width", "anomaly")), mask, "value")
    return packed.select("cell", "win", *[r(F.col("value")[c]).alias(c) for c in ("mean", "width", "anomaly")])


_BOUNDS = ("value", "pi_lo", "pi_hi")


@query(f"WITH {_INTERVAL} SELECT cell, year, {', '.join(f'round({V.sql_mean(c, 9)}, 4) AS {c}' for c in _BOUNDS)}, count(value) AS months FROM i GROUP BY cell, year")
def q_bounds_rollup(spark, d):
    """Years of cells: the mean of their months and of the months' bounds."""
    return _intervals(spark, d).groupBy("cell", "year").agg(*[r(M.exact_mean(F.col(c), 9)).alias(c) for c in _BOUNDS], F.count("value").alias("months"))


@query(f"""WITH {V.SQL_ESM}, k AS (SELECT *, year + {S.MODEL_YEAR_OFFSET} AS my FROM esm), f AS (SELECT *, my - my % 2 AS lo FROM k), n AS (SELECT * FROM f WHERE lo <= {1995 + S.MODEL_YEAR_OFFSET} AND lo + 1 >= {1994 + S.MODEL_YEAR_OFFSET})
SELECT year, month, 15 + 8.0::DOUBLE * lat_idx AS lat, -170 + 10.0::DOUBLE * lon_idx AS lon, round((value + 273.15::DOUBLE) - 273.15::DOUBLE, 3) AS tas, CASE WHEN cell % 5 <> 0 THEN round((value / 86400.0::DOUBLE) * 86400.0::DOUBLE, 3) END AS pr FROM n""")
def q_run_files(spark, d):
    """A run as files of two model years for each variable, those of 1994 to 1995 read back and joined; precipitation lacks some cells."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    year = F.col("year") + S.MODEL_YEAR_OFFSET
    low = year - year % 2
    raw = {"tas": F.col("value") + S.KELVIN, "pr": F.when(F.col("cell") % 5 != 0, F.col("value") / S.SECONDS_PER_DAY)}
    cells = V.esm(spark, d).select(year.alias("model_year"), "month", (15 + 8.0 * F.col("lat_idx")).alias("lat"), F.pmod(190 + 10.0 * F.col("lon_idx"), F.lit(360.0)).alias("lon"), *[v.alias(n) for n, v in raw.items()], F.format_string("%05d01-%05d12", low, low + 1).alias("span"))
    long = cells.select("model_year", "month", "lat", "lon", "span", F.inline(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).alias("value")) for n in raw])))
    long.where("value IS NOT NULL").withColumn("of", F.concat_ws("_", "variable", "span")).drop("span").repartition("of", "lat").write.partitionBy("variable", "of").parquet(folder)
    run = fields.load_run(spark, {n: f"{folder}/variable={n}" for n in raw}, "model_year", 1994, 1995)
    return fields.joined(run, list(raw)).select("year", "month", "lat", "lon", *[r(n, 3).alias(n) for n in raw])


_VERSIONS = f"""{V.SQL_OBSQ}, a AS (SELECT * FROM obs WHERE (id + month) % 3 <> 0), b AS (SELECT id, year, month, value + CASE WHEN id % 4 = 0 AND year < 1996 THEN 0.3::DOUBLE * month ELSE 0 END AS value FROM obs WHERE (id + month) % 3 <> 1),
j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.year, b.year) AS year, coalesce(a.month, b.month) AS month, a.id IS NOT NULL AND b.id IS NOT NULL AS two, abs(a.value - b.value) AS gap, abs(a.value - b.value) > 0.005::DOUBLE + 0.00001::DOUBLE * abs(b.value) AS differs
FROM a FULL OUTER JOIN b ON a.id = b.id AND a.year = b.year AND a.month = b.month)"""
_LIMITS = {"over_001": 0.01, "over_1": 1.0, "over_3": 3.05}


def _versions(spark, d):
    """Two versions of the observations: each lacks rows of the other, and early values of some stations are shifted."""
    o = V.obs(spark, d, "l_quantity")
    shift = F.when((F.col("id") % 4 == 0) & (F.col("year") < 1996), F.lit(0.3) * F.col("month")).otherwise(F.lit(0.0))
    a, b = o.where((F.col("id") + F.col("month")) % 3 != 0), o.where((F.col("id") + F.col("month")) % 3 != 1).withColumn("value", F.col("value") + shift)
    return comparison.compared(a, b, ["id", "year", "month"], 0.005)


@query(f"WITH {_VERSIONS} SELECT id, count(*) FILTER (two) AS matched, count(*) AS total, count(*) FILTER (differs) AS n_diff, round(count(*) FILTER (differs) / CAST(count(*) AS DOUBLE), 4) AS fraction FROM j GROUP BY id")
def q_station_differences(spark, d):
    """Each station's rows in both versions and in either, and the share that differs."""
    return comparison.differences_by(_versions(spark, d), ["id"]).withColumn("fraction", r("fraction"))


@query(f"WITH {_VERSIONS} SELECT CAST(year // 10 * 10 AS INT) AS decade, count(*) AS n_diff FROM j WHERE differs GROUP BY 1")
def q_difference_decades(spark, d):
    return comparison.differences_by_decade(_versions(spark, d))


@query(f"WITH {_VERSIONS}, s AS (SELECT id, count(*) FILTER (differs) AS n, count(*) AS total FROM j GROUP BY id) SELECT count(*) AS groups, count(*) FILTER (n = 0) AS equal, count(*) FILTER (n > 0) AS differing, count(*) FILTER (2 * n > total) AS mostly FROM s")
def q_difference_spread(spark, d):
    return comparison.spread(comparison.differences_by(_versions(spark, d), ["id"]))


@query(f"WITH {_VERSIONS} SELECT month, count(gap) AS n, round(max(gap), 4) AS largest, round({V.sql_mean('gap', 9)}, 4) AS mean, round(median(gap), 4) AS median, {', '.join(f'round(avg(CASE WHEN gap > {x}::DOUBLE THEN 1.0 ELSE 0.0 END), 4) AS {n}' for n, x in _LIMITS.items())} FROM j WHERE gap IS NOT NULL GROUP BY month")
def q_parity_months(spark, d):
    """How far the versions are apart in each month: largest, mean and median gap, and shares above limits."""
    rows = comparison.parity(_versions(spark, d), ["month"], _LIMITS)
    return rows.select("month", "n", *[r(c).alias(c) for c in ("largest", "mean", "median", *_LIMITS)])


@query(f"WITH {V.SQL_OBS}, {V.SQL_META}, n AS (SELECT id FROM meta WHERE lat BETWEEN 25 AND 60) SELECT id, year, month, round(value, 2) AS value FROM obs WHERE id IN (SELECT id FROM n) AND year >= 1995")
def q_reconstruction_csv(spark, d):
    """A reconstruction as CSV of four decimals, of which the series of a list of stations are read: three of seven columns are not parsed."""
    path = f"{shared_folder(spark)}/reconstruction-{uuid.uuid4().hex}.csv"
    o = V.obs(spark, d).withColumn("value", r("value", 2))
    fields.write_reconstruction(o.select("id", "year", "month", "value", (F.col("value") - 1).alias("pi_lo"), (F.col("value") + 1).alias("pi_hi"), F.lit("tas").alias("var")), path, csv=True)
    rows = fields.open_store(spark, path, "id long, year int, month int, value double")
    named = V.meta(spark, d).where(F.col("lat").between(25, 60)).select("id")
    return rows.where("year >= 1995").join(named, "id", "left_semi").select("id", "year", "month", "value")
