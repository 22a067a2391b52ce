"""Queries over observations and fields that SQL can express, each beside its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratocline.functions import metrics as M
from stratocline.functions import scalars as S
from stratocline.operators import ensemble, grids, moving, raster, selection
from stratocline.operators.percentiles import exact_percentiles
from stratocline.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def half_even_sql(sql: str) -> str:
    """SQL whose ``round(value, digits)`` take ties to the even digit, by the same steps as ``scalars.half_even``."""
    out, at = "", 0
    while (found := re.search(r"\bround\(", sql[at:])) is not None:
        start = at + found.end()
        depth, comma, i = 1, None, start
        while depth:
            depth += (sql[i] == "(") - (sql[i] == ")")
            if depth == 1 and sql[i] == ",":
                comma = i
            i += 1
        out += sql[at : at + found.start()]
        if comma is None:
            out += f"round({half_even_sql(sql[start : i - 1])})"
        else:
            scale = f"1e{int(sql[comma + 1 : i - 1])}::DOUBLE"
            out += f"(round_even(({half_even_sql(sql[start:comma])}) * {scale}, 0) / {scale})"
        at = i
    return out + sql[at:]


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL, in which ``round`` takes ties to the even digit."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = half_even_sql(sql)
        return f

    return add


def r(c, digits: int = 4):
    return S.half_even(F.col(c) if isinstance(c, str) else c, digits)


def _mean(c: str):
    """Means of monthly means, which have no end of decimals: the same for any order of rows."""
    return M.exact_mean(F.col(c), 9)


@query(f"WITH {V.SQL_OBSQ} SELECT id, year, month, round(value, 4) AS value FROM obs")
def q_obs_monthly(spark, d):
    return V.obs(spark, d, "l_quantity").select("id", "year", "month", r("value").alias("value"))


@query(f"WITH {V.SQL_OBSQ} SELECT id, year, month, round(value, 4) AS value FROM obs WHERE id IN (SELECT id FROM obs GROUP BY id HAVING count(value) >= 60)")
def q_min_record_semi(spark, d):
    return selection.with_records(V.obs(spark, d, "l_quantity"), 60).select("id", "year", "month", r("value").alias("value"))


@query(f"WITH {V.SQL_OBS}, few AS (SELECT id FROM obs GROUP BY id HAVING count(*) < 83) SELECT id, count(*) AS n FROM obs WHERE id NOT IN (SELECT id FROM few) GROUP BY id")
def q_removed_anti(spark, d):
    o = V.obs(spark, d)
    few = o.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n < 83").select("id")
    return o.join(few, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.SQL_OBSQ}, {V.SQL_META} SELECT o.id, o.year, o.month, round(o.value, 4) AS value FROM obs o JOIN meta m USING (id) WHERE m.lat BETWEEN 25 AND 65 AND m.lon BETWEEN -145 AND -65 AND o.year BETWEEN 1996 AND 1999")
def q_bbox_time_filter(spark, d):
    inside = selection.in_box(V.meta(spark, d), (30, 60), (-140, -70), pad=5).select("id")
    return selection.in_years(V.obs(spark, d, "l_quantity"), 1996, 1999).join(inside, "id").select("id", "year", "month", r("value").alias("value"))


@query(f"WITH {V.SQL_META} SELECT id, round(((lon + 360 + 180) % 360) - 180, 4) AS lon FROM meta")
def q_lon_wrap(spark, d):
    return V.meta(spark, d).select("id", r(S.wrap_longitude(F.col("lon") + 360)).alias("lon"))


_PIVOT = ", ".join(f"max(CASE WHEN month = {m} THEN round(value, 4) END) AS m{m}" for m in range(1, 13))


@query(f"WITH {V.SQL_OBSQ} SELECT id, year, {_PIVOT} FROM obs GROUP BY id, year")
def q_pivot_months(spark, d):
    return selection.pivot_months(V.obs(spark, d, "l_quantity").withColumn("value", r("value")))


@query(f"WITH {V.SQL_OBSQ}, y AS (SELECT DISTINCT id, year FROM obs), m AS (SELECT CAST(unnest(range(1, 13)) AS INT) AS month) SELECT y.id, y.year, m.month, round(o.value, 4) AS value FROM y CROSS JOIN m LEFT JOIN obs o ON o.id = y.id AND o.year = y.year AND o.month = m.month")
def q_unpivot_months(spark, d):
    return selection.unpivot_months(selection.pivot_months(V.obs(spark, d, "l_quantity"))).select("id", "year", "month", r("value").alias("value"))


@query("WITH t AS (SELECT o_orderkey AS k, -(o_orderkey % 264000) / 12000.0::DOUBLE AS ka FROM orders), m AS (SELECT k, CAST(round_even((1950.0 + ka * 1000.0) * 12.0, 0) AS BIGINT) AS m FROM t) SELECT k, CAST(floor(m / 12.0::DOUBLE) AS INT) AS year, CAST(((m % 12) + 12) % 12 + 1 AS INT) AS month, CAST(k % 26000 - 23051 AS BIGINT) AS ce FROM m")
def q_kabp_calendar(spark, d):
    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select(k.alias("k"), S.months_of_ka(-(k % 264000) / 12000.0).alias("m"))
    return rows.select("k", S.year_of_months(F.col("m")).alias("year"), S.month_of_months(F.col("m")).alias("month"), S.model_year_to_ce(F.col("k") % 26000).alias("ce"))


@query(f"WITH {V.SQL_OBSQ} SELECT id, year, month, CAST(day(last_day(make_date(year, month, 1))) AS INT) AS days, round(value / 10.0 / day(last_day(make_date(year, month, 1))), 6) AS daily FROM obs")
def q_days_in_month_rate(spark, d):
    y, m = F.col("year"), F.col("month")
    return V.obs(spark, d, "l_quantity").select("id", "year", "month", S.days_in_month(y, m).alias("days"), r(S.tenths_per_month_to_daily(F.col("value"), y, m), 6).alias("daily"))


@query(f"WITH {V.SQL_OBSQ}, {V.SQL_META} SELECT o.id, o.year, o.month, round(o.value, 4) AS value, round(m.lat, 2) AS lat, round(m.lon, 2) AS lon, coalesce(CASE WHEN m.id % 5 = 0 THEN NULL ELSE 'cal' END, 'removed') AS flag FROM obs o LEFT JOIN meta m ON m.id = o.id")
def q_left_join_meta(spark, d):
    m = V.meta(spark, d).withColumn("flag", F.when(F.col("id") % 5 != 0, "cal"))
    return V.obs(spark, d, "l_quantity").join(m, "id", "left").select("id", "year", "month", r("value").alias("value"), r("lat", 2).alias("lat"), r("lon", 2).alias("lon"), F.coalesce("flag", F.lit("removed")).alias("flag"))


@query(f"WITH {V.SQL_OBSQ}, a AS (SELECT * FROM obs WHERE (id + month) % 3 <> 0), b AS (SELECT id, year, month, value + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS value FROM obs WHERE (id + month) % 3 <> 1) SELECT coalesce(a.id, b.id) AS id, coalesce(a.year, b.year) AS year, coalesce(a.month, b.month) AS month, CASE WHEN a.id IS NULL THEN 'right_only' WHEN b.id IS NULL THEN 'left_only' ELSE 'both' END AS found, abs(a.value - b.value) > 0.005 AS differs FROM a FULL OUTER JOIN b ON a.id = b.id AND a.year = b.year AND a.month = b.month")
def q_full_outer_diff(spark, d):
    o = V.obs(spark, d, "l_quantity")
    a = o.where((F.col("id") + F.col("month")) % 3 != 0)
    b = o.where((F.col("id") + F.col("month")) % 3 != 1).withColumn("value", F.col("value") + F.when(F.col("id") % 4 == 0, 1).otherwise(0))
    return selection.outer_diff(a, b, ["id", "year", "month"], 0.005).select("id", "year", "month", "found", "differs")


SQL_AXES = "la AS (SELECT CAST(unnest(range(8)) AS INT) AS i), lo AS (SELECT CAST(unnest(range(12)) AS INT) AS j)"
SQL_NEAR = f"near AS (SELECT m.id, m.lat, m.lon, (SELECT arg_min(i, abs(15.0 + 8 * i - m.lat) * 1000000 + i) FROM la) AS lat_idx, (SELECT arg_min(j, abs(-170.0 + 10 * j - m.lon) * 1000000 + j) FROM lo) AS lon_idx FROM meta m)"


@query(f"WITH {V.SQL_META}, {V.SQL_ESM}, {SQL_AXES}, {SQL_NEAR} SELECT n.id, n.lat_idx, n.lon_idx, e.year, e.month, round(e.value, 4) AS value FROM near n JOIN esm e ON e.lat_idx = n.lat_idx AND e.lon_idx = n.lon_idx")
def q_nearest_axis_join(spark, d):
    return grids.at_nearest_cell(V.meta(spark, d), V.esm(spark, d), V.LAT_AXIS, V.LON_AXIS, []).select("id", "lat_idx", "lon_idx", "year", "month", r("value").alias("value"))


_CELLS = "cells AS (SELECT CAST(i * 13 + j AS BIGINT) AS cell, CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx, 15.0 + i * 10.0 AS lat, -170.0 + j * 10.0 AS lon FROM (SELECT unnest(range(7)) AS i) CROSS JOIN (SELECT unnest(range(13)) AS j))"
SMALL_GRID = grids.GridSpec(15.0, 75.0, -170.0, -50.0, 10.0)


@query(f"WITH {V.SQL_META}, {_CELLS}, k AS (SELECT cell, m.id, row_number() OVER (PARTITION BY cell ORDER BY (c.lon - m.lon) ** 2 + (c.lat - m.lat) ** 2, m.id) AS n FROM cells c CROSS JOIN meta m) SELECT cell, id FROM k WHERE n = 1")
def q_nearest_station(spark, d):
    points = SMALL_GRID.cells(spark).select("cell", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return grids.nearest_station(points, V.meta(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")))


@query(f"WITH {V.SQL_ESM} SELECT year, month, cell, round(value - {V.sql_mean('value', 9, 'OVER (PARTITION BY cell)')}, 4) AS anomaly FROM esm")
def q_anomaly(spark, d):
    return moving.anomaly(V.esm(spark, d), ["cell"], "value", "a", 9).select("year", "month", "cell", r("a").alias("anomaly"))


@query(f"WITH {V.SQL_OBSQ} SELECT id, year, month, round(value - {V.sql_mean('value', 9, 'OVER (PARTITION BY id, month)')}, 4) AS centred FROM obs")
def q_center_station(spark, d):
    return moving.anomaly(V.obs(spark, d, "l_quantity"), ["id", "month"], "value", "a", 9).select("id", "year", "month", r("a").alias("centred"))


def _moved(k: int) -> str:
    return f"WITH {V.SQL_OBSQ} SELECT id, year, month, round(avg(value) OVER (PARTITION BY id ORDER BY year, month ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING), 4) AS mm FROM obs"


def _movmean(spark, d, k):
    w = moving.frame(["id"], ["year", "month"], k)
    return V.obs(spark, d, "l_quantity").select("id", "year", "month", r(moving.moving_mean(F.col("value"), w)).alias("mm"))


@query(_moved(30))
def q_movmean_even(spark, d):
    return _movmean(spark, d, 30)


@query(_moved(5))
def q_movmean_odd(spark, d):
    return _movmean(spark, d, 5)


@query(_moved(360))
def q_movmean_360(spark, d):
    o = V.obs(spark, d, "l_quantity")
    return moving.long_moving_mean(o, ["id"], ["year", "month"], "value", 360, "m").select("id", "year", "month", r("m").alias("mm"))


_W30 = "PARTITION BY id ORDER BY year, month ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING"


@query(f"WITH {V.SQL_OBSQ} SELECT id, year, month, round(CASE WHEN count(value) OVER w = 1 THEN 0.0 ELSE stddev_samp(value) OVER w END, 4) AS ms FROM obs WINDOW w AS ({_W30})")
def q_movstd(spark, d):
    w = moving.frame(["id"], ["year", "month"], 30)
    return V.obs(spark, d, "l_quantity").select("id", "year", "month", r(moving.moving_std(F.col("value"), w)).alias("ms"))


@query(f"""WITH {V.SQL_OBSQ}, b AS (SELECT id, year, month, value AS p, value * 0.5 + (id % 7) + (month % 3) AS e FROM obs),
m AS (SELECT *, avg(p) OVER w AS mp, avg(e) OVER w AS me FROM b WINDOW w AS ({_W30})), a AS (SELECT *, p - mp AS ap, e - me AS ae FROM m),
s AS (SELECT *, CASE WHEN count(ap) OVER w = 1 THEN 0.0 ELSE stddev_samp(ap) OVER w END AS sp, CASE WHEN count(ae) OVER w = 1 THEN 0.0 ELSE stddev_samp(ae) OVER w END AS se FROM a WINDOW w AS ({_W30}))
SELECT id, year, month, round(mp + ap * coalesce(se / nullif(sp, 0), 1.0), 4) AS corrected FROM s""")
def q_variance_correction(spark, d):
    b = V.obs(spark, d, "l_quantity").withColumn("e", F.col("value") * 0.5 + F.col("id") % 7 + F.col("month") % 3)
    return moving.variance_correction(b, ["id"], ["year", "month"], "value", "e", 30, "c").select("id", "year", "month", r("c").alias("corrected"))


@query(f"""WITH {V.SQL_OBSQ}, b AS (SELECT id, year, month, value AS p, value * 0.5 + (month % 3) AS e FROM obs),
s AS (SELECT *, p * (stddev_pop(e) OVER w) / nullif(stddev_pop(p) OVER w, 0) AS c FROM b WINDOW w AS (PARTITION BY id ORDER BY year, month ROWS BETWEEN 359 PRECEDING AND CURRENT ROW))
SELECT id, year, month, round(c, 4) AS rescaled FROM s""")
def q_variance_rescale_trailing(spark, d):
    b = V.obs(spark, d, "l_quantity").withColumn("e", F.col("value") * 0.5 + F.col("month") % 3)
    return moving.trailing_rescale(b, ["id"], ["year", "month"], "value", "e", 360, "c").select("id", "year", "month", r("c").alias("rescaled"))


_W_MONTH = "PARTITION BY cell, month ORDER BY year ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING"


@query(f"WITH {V.SQL_ESM} SELECT year, month, cell, round(avg(value) OVER ({_W_MONTH}) - avg(CASE WHEN year <= 1998 THEN value END) OVER (PARTITION BY cell, month), 4) AS delta FROM esm")
def q_delta_change_tas(spark, d):
    return moving.delta_change(V.esm(spark, d), ["cell", "month"], ["year"], "value", F.col("year") <= 1998, 30, "x").select("year", "month", "cell", r("x").alias("delta"))


@query(f"WITH {V.SQL_ESM}, l AS (SELECT *, ln(value + 1 + min(CASE WHEN year <= 1998 THEN value END) OVER (PARTITION BY cell, month)) AS g FROM esm) SELECT year, month, cell, round(avg(g) OVER ({_W_MONTH}) - avg(CASE WHEN year <= 1998 THEN g END) OVER (PARTITION BY cell, month), 6) AS delta FROM l")
def q_delta_change_log(spark, d):
    return moving.delta_change(V.esm(spark, d), ["cell", "month"], ["year"], "value", F.col("year") <= 1998, 30, "x", log=True).select("year", "month", "cell", r("x", 6).alias("delta"))


@query(f"WITH {V.SQL_OBSQ}, l AS (SELECT *, 1 + min(value) OVER (PARTITION BY id) AS o_t FROM obs) SELECT id, year, month, round(ln(value + o_t), 6) AS g, round(exp(ln(value + o_t)) - o_t, 6) AS back FROM l")
def q_log_link_roundtrip(spark, d):
    o = V.obs(spark, d, "l_quantity").withColumn("o_t", 1 + F.min("value").over(Window.partitionBy("id")))
    g = S.log_link(F.col("value"), F.col("o_t"))
    return o.select("id", "year", "month", r(g, 6).alias("g"), r(S.inverse_log_link(g, F.col("o_t")), 6).alias("back"))


@query(f"WITH {V.SQL_OBSQ}, v AS (SELECT *, var_pop(value) OVER (PARTITION BY id) AS s2 FROM obs) SELECT id, year, month, round(value - 1.96 * sqrt(s2), 4) AS lo, round(value + 1.96 * sqrt(s2), 4) AS hi FROM v")
def q_pi_normal(spark, d):
    o = V.obs(spark, d, "l_quantity").withColumn("s2", F.var_pop("value").over(Window.partitionBy("id")))
    lo, hi = S.normal_interval(F.col("value"), F.col("s2"))
    return o.select("id", "year", "month", r(lo).alias("lo"), r(hi).alias("hi"))


@query(f"""WITH {V.SQL_OBSQ}, v AS (SELECT *, var_pop(ln(value)) OVER (PARTITION BY id) AS s2, 1 + min(value) OVER (PARTITION BY id) AS o_t FROM obs)
SELECT id, year, month, round(greatest(greatest(value + o_t, 1e-10) * exp(-s2 / 2 - 1.96 * sqrt(s2)) - o_t, 0), 4) AS lo, round(greatest(greatest(value + o_t, 1e-10) * exp(-s2 / 2 + 1.96 * sqrt(s2)) - o_t, 0), 4) AS hi FROM v""")
def q_pi_lognormal(spark, d):
    w = Window.partitionBy("id")
    o = V.obs(spark, d, "l_quantity").withColumn("s2", F.var_pop(F.ln("value")).over(w)).withColumn("o_t", 1 + F.min("value").over(w))
    lo, hi = S.lognormal_interval(F.col("value"), F.col("o_t"), F.col("s2"))
    return o.select("id", "year", "month", r(lo).alias("lo"), r(hi).alias("hi"))


_E2 = "(2.0/298.257222101::DOUBLE - 1.0/298.257222101::DOUBLE/298.257222101::DOUBLE)"


@query(f"""WITH {V.SQL_META}, k AS (SELECT {_E2} AS e2, sqrt({_E2}) AS e),
f AS (SELECT *, sin(radians(29.5)) AS s1, sin(radians(45.5)) AS s2, sin(radians(23.0)) AS s0 FROM k),
q AS (SELECT *, (1-e2)*(s1/(1-e2*s1*s1)-ln((1-e*s1)/(1+e*s1))/(2*e)) AS q1, (1-e2)*(s2/(1-e2*s2*s2)-ln((1-e*s2)/(1+e*s2))/(2*e)) AS q2, (1-e2)*(s0/(1-e2*s0*s0)-ln((1-e*s0)/(1+e*s0))/(2*e)) AS q0,
  cos(radians(29.5))/sqrt(1-e2*s1*s1) AS m1, cos(radians(45.5))/sqrt(1-e2*s2*s2) AS m2 FROM f),
n AS (SELECT *, (m1*m1-m2*m2)/(q2-q1) AS n FROM q), c AS (SELECT *, m1*m1+n*q1 AS c FROM n),
p AS (SELECT meta.id, c.*, sin(radians(meta.lat)) AS s, radians(meta.lon + 96.0)*n AS th FROM meta CROSS JOIN c),
t AS (SELECT *, 6378137.0*sqrt(c - n*((1-e2)*(s/(1-e2*s*s)-ln((1-e*s)/(1+e*s))/(2*e))))/n AS rho, 6378137.0*sqrt(c-n*q0)/n AS rho0 FROM p)
SELECT id, round(rho*sin(th), 2) AS x, round(rho0 - rho*cos(th), 2) AS y FROM t""")
def q_albers(spark, d):
    x, y = S.albers(F.col("lat"), F.col("lon"))
    return V.meta(spark, d).select("id", r(x, 2).alias("x"), r(y, 2).alias("y"))


_CELL_OF = "CAST(floor((lat - 15.0::DOUBLE) / 0.2::DOUBLE + 0.5::DOUBLE) AS INT) AS lat_idx, CAST(floor((lon + 170.0::DOUBLE) / 0.2::DOUBLE + 0.5::DOUBLE) AS INT) AS lon_idx"


@query(f"""WITH {V.SQL_META}, s AS (SELECT lat_idx, lon_idx, count(*) AS stations FROM (SELECT {_CELL_OF} FROM meta) GROUP BY ALL),
g AS (SELECT CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx FROM (SELECT unnest(range(301)) AS i) CROSS JOIN (SELECT unnest(range(601)) AS j))
SELECT CAST(lat_idx * 601 + lon_idx AS BIGINT) AS cell, lat_idx, lon_idx, round(15.0::DOUBLE + lat_idx * 0.2::DOUBLE, 4) AS lat, round(-170.0::DOUBLE + lon_idx * 0.2::DOUBLE, 4) AS lon, coalesce(stations, 0) AS stations FROM g LEFT JOIN s USING (lat_idx, lon_idx)""")
def q_grid_axes(spark, d):
    """The production grid with the stations nearest to each of its cells."""
    grid = grids.NORTH_AMERICA
    i, j = (F.floor((F.col(c) - F.lit(lo)) / grid.step + 0.5).cast("int").alias(n) for c, lo, n in (("lat", grid.lat_min, "lat_idx"), ("lon", grid.lon_min, "lon_idx")))
    stations = V.meta(spark, d).select(i, j).groupBy("lat_idx", "lon_idx").agg(F.count(F.lit(1)).alias("stations"))
    cells = grid.cells(spark).join(stations, ["lat_idx", "lon_idx"], "left")
    return cells.select("cell", "lat_idx", "lon_idx", r("lat").alias("lat"), r("lon").alias("lon"), F.coalesce("stations", F.lit(0)).alias("stations"))


@query(f"WITH {V.SQL_ESM} SELECT year, month, cell, CASE WHEN (lat_idx * 31 + lon_idx * 17) % 5 <> 0 THEN round(value, 4) END AS value FROM esm")
def q_landmask(spark, d):
    mask = spark.range(96).select(F.floor(F.col("id") / 12).cast("int").alias("lat_idx"), (F.col("id") % 12).cast("int").alias("lon_idx")).withColumn("is_land", (F.col("lat_idx") * 31 + F.col("lon_idx") * 17) % 5 != 0)
    return grids.masked(V.esm(spark, d), mask, "value").select("year", "month", "cell", r("value").alias("value"))


@query(f"""WITH {V.SQL_ESM}, {_CELLS}, {SQL_AXES}, n AS (SELECT c.cell AS target, CASE WHEN c.lat BETWEEN 15 AND 71 THEN (SELECT arg_min(i, abs(15.0 + 8 * i - c.lat) * 1000000 + i) FROM la) END AS lat_idx,
CASE WHEN c.lon BETWEEN -170 AND -60 THEN (SELECT arg_min(j, abs(-170.0 + 10 * j - c.lon) * 1000000 + j) FROM lo) END AS lon_idx FROM cells c)
SELECT n.target, e.year, e.month, round(e.value, 4) AS value FROM n LEFT JOIN esm e ON e.lat_idx = n.lat_idx AND e.lon_idx = n.lon_idx""")
def q_regrid_nearest(spark, d):
    cells = SMALL_GRID.cells(spark).select(F.col("cell").alias("target"), grids.nearest_index_within(F.col("lat"), V.LAT_AXIS).alias("lat_idx"), grids.nearest_index_within(F.col("lon"), V.LON_AXIS).alias("lon_idx"))
    return cells.join(V.esm(spark, d), ["lat_idx", "lon_idx"], "left").select("target", "year", "month", r("value").alias("value"))


_TEST = (1877, 1884, 1890, 1897, 1910, 1921, 1922, 1933, 1958, 1963, 1977)
_VAL = (1878, 1885, 1887, 1889, 1891, 1892, 1894, 1900, 1904, 1906, 1908, 1916, 1919, 1923, 1926, 1930, 1935, 1937, 1942, 1944, 1945, 1948, 1949, 1950, 1951, 1956, 1964, 1966, 1968, 1969, 1975, 1979, 1980, 1986, 1987, 1992, 1993, 1997)


@query(f"WITH {V.SQL_OBS}, y AS (SELECT year - (id % 17) * 7 AS y, count(*) AS n FROM obs GROUP BY ALL) SELECT CAST(y AS INT) AS year, CASE WHEN y IN {_TEST} THEN 'test' WHEN y IN {_VAL} THEN 'val' ELSE 'cal' END AS role, y <= 1949 AS in_second, n FROM y")
def q_split_years(spark, d):
    """Years of records, each station's set back by its own number of years, with their role and the values in them."""
    roles = selection.split_years(1875, 1999, 38, 11)
    years = V.obs(spark, d).select((F.col("year") - F.col("id") % 17 * 7).cast("int").alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return years.select("year", selection.year_role(F.col("year"), roles).alias("role"), (F.col("year") <= 1949).alias("in_second"), "n")


_FLAGS = f"flags AS (SELECT id, CAST(floor(count(CASE WHEN year NOT IN {(*V.TEST_YEARS, *V.VAL_YEARS)} THEN value END) / 12.0) AS BIGINT) AS n_cal FROM obs GROUP BY id), flagged AS (SELECT id, n_cal, CASE WHEN n_cal < 2 THEN 'removed' WHEN n_cal < 3 THEN 'test_only' ELSE 'cal' END AS flag FROM flags)"
_GAPS = "gaps AS (SELECT id, year, month, CASE WHEN (id * 31 + year * 12 + month) % 7 = 0 OR (id % 3 = 0 AND year > 1995) OR (id % 3 = 1 AND year > 1997) THEN NULL ELSE value END AS value FROM full_obs)"
_FLAG_BASE = f"{V.SQL_OBS.replace('obs AS', 'full_obs AS', 1)}, {_GAPS}, obs AS (SELECT * FROM gaps), {_FLAGS}"


def _flags(spark, d):
    o = V.obs_with_gaps(spark, d)
    late = ((F.col("id") % 3 == 0) & (F.col("year") > 1995)) | ((F.col("id") % 3 == 1) & (F.col("year") > 1997))
    o = o.withColumn("value", F.when(~late, F.col("value")))
    cal = [y for y in range(1990, 2010) if y not in (*V.TEST_YEARS, *V.VAL_YEARS)]
    return o, selection.station_flags(o, cal, 2, 3)


@query(f"WITH {_FLAG_BASE} SELECT id, n_cal, flag FROM flagged")
def q_station_flags(spark, d):
    return _flags(spark, d)[1]


@query(f"""WITH {_FLAG_BASE}, l AS (SELECT CASE WHEN flag = 'removed' THEN 'removed' WHEN flag = 'test_only' THEN 'test' WHEN year IN {V.TEST_YEARS} THEN 'test' WHEN year = {V.VAL_YEARS[0]} THEN 'val' ELSE 'cal' END AS split, value FROM obs JOIN flagged USING (id))
SELECT split, count(value) AS n, round(100.0 * count(value) / (SELECT count(value) FROM l), 4) AS pct FROM l GROUP BY split""")
def q_split_matrix(spark, d):
    o, flags = _flags(spark, d)
    role = selection.year_role(F.col("year"), {"test": list(V.TEST_YEARS), "val": list(V.VAL_YEARS)})
    counted = o.join(flags, "id").groupBy(selection.split_label(role, F.col("flag")).alias("split")).agg(F.count("value").alias("n"))
    return counted.select("split", "n", r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


def _kge_sql(p: str, o: str) -> str:
    return f"1 - sqrt(power(covar_pop({p}, {o}) / nullif(stddev_pop({p}) * stddev_pop({o}), 0) - 1, 2) + power(stddev_pop({p}) / nullif(stddev_pop({o}), 0) - 1, 2) + power(avg({p}) / nullif(avg({o}), 0) - 1, 2))"


def _long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"p_{n}").alias("p"), F.col(f"e_{n}").alias("e")) for n in names])))


def _timestep(spark, d):
    rows = selection.by_season(V.pairs(spark, d).where(F.col("year").isin(*V.TEST_YEARS)))
    c = F.col
    return rows.groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), M.mean_bias(c("p"), c("o")).alias("p_MB"), M.mean_bias(c("e"), c("o")).alias("e_MB"), M.mean_absolute_error(c("p"), c("o")).alias("p_MAE"), M.mean_absolute_error(c("e"), c("o")).alias("e_MAE"),
        M.kge(c("p"), c("o"), 10).alias("p_KGE"), M.kge(c("e"), c("o"), 10).alias("e_KGE"),
    )


_T1 = f"""WITH {V.SQL_PAIRS}, {V.SQL_SEASONS}, s AS (SELECT season, p, o, e FROM pairs JOIN seasons USING (month) WHERE year IN {V.TEST_YEARS}),
t1 AS (SELECT season, count(*) AS n, avg(p - o) AS p_mb, avg(e - o) AS e_mb, avg(abs(p - o)) AS p_mae, avg(abs(e - o)) AS e_mae, {_kge_sql('p', 'o')} AS p_kge, {_kge_sql('e', 'o')} AS e_kge FROM s GROUP BY season),
long AS (SELECT season, n, 'MB' AS metric, p_mb AS p, e_mb AS e FROM t1 UNION ALL SELECT season, n, 'MAE', p_mae, e_mae FROM t1 UNION ALL SELECT season, n, 'KGE', p_kge, e_kge FROM t1)"""


@query(f"{_T1} SELECT season, n, metric, round(p, 3) AS p, round(e, 3) AS e FROM long")
def q_metrics_mb_mae_kge(spark, d):
    return _long(_timestep(spark, d), ["season", "n"], ["MB", "MAE", "KGE"]).select("season", "n", "metric", r("p", 3).alias("p"), r("e", 3).alias("e"))


@query(f"""WITH {V.SQL_PAIRS}, {V.SQL_SEASONS}, s AS (SELECT season, id, avg(p) AS p, avg(o) AS o, avg(e) AS e FROM pairs JOIN seasons USING (month) WHERE year IN {V.TEST_YEARS} GROUP BY season, id),
a AS (SELECT season, count(*) AS n_stations, covar_pop(p, o) / nullif(stddev_pop(p) * stddev_pop(o), 0) AS p_r, covar_pop(e, o) / nullif(stddev_pop(e) * stddev_pop(o), 0) AS e_r, avg(p - o) AS p_mb, avg(e - o) AS e_mb, avg(abs(p - o)) AS p_mae, avg(abs(e - o)) AS e_mae FROM s GROUP BY season HAVING count(*) >= 3)
SELECT season, n_stations, 'r' AS metric, round(p_r, 3) AS p, round(e_r, 3) AS e FROM a UNION ALL SELECT season, n_stations, 'MB', round(p_mb, 3), round(e_mb, 3) FROM a UNION ALL SELECT season, n_stations, 'MAE', round(p_mae, 3), round(e_mae, 3) FROM a""")
def q_station_metrics(spark, d):
    c = F.col
    s = selection.by_season(V.pairs(spark, d).where(c("year").isin(*V.TEST_YEARS))).groupBy("season", "id").agg(F.avg("p").alias("p"), F.avg("o").alias("o"), F.avg("e").alias("e")).na.drop()
    a = s.groupBy("season").agg(F.count(F.lit(1)).alias("n_stations"), M.safe_corr(c("p"), c("o")).alias("p_r"), M.safe_corr(c("e"), c("o")).alias("e_r"), M.mean_bias(c("p"), c("o")).alias("p_MB"), M.mean_bias(c("e"), c("o")).alias("e_MB"), M.mean_absolute_error(c("p"), c("o")).alias("p_MAE"), M.mean_absolute_error(c("e"), c("o")).alias("e_MAE"))
    return _long(a.where("n_stations >= 3"), ["season", "n_stations"], ["r", "MB", "MAE"]).select("season", "n_stations", "metric", r("p", 3).alias("p"), r("e", 3).alias("e"))


@query(f"""{_T1}, x AS (SELECT metric, CASE metric WHEN 'MB' THEN 1 - abs(p) / nullif(abs(e), 0) WHEN 'MAE' THEN 1 - p / nullif(e, 0) ELSE (p - e) / nullif(1 - e, 0) END AS score, e FROM (SELECT metric, round(p, 3) AS p, round(e, 3) AS e FROM long)),
w AS (SELECT metric, avg(abs(e)) AS weight FROM x WHERE score IS NOT NULL GROUP BY metric)
SELECT 'tas' AS var, round(100 * sum(weight * score) / sum(weight), 1) AS mss_pct, count(*) AS n_components FROM x JOIN w USING (metric) WHERE score IS NOT NULL""")
def q_mss(spark, d):
    return ensemble.mean_skill(q_metrics_mb_mae_kge(spark, d).withColumn("var", F.lit("tas")), ["var"]).select("var", r("mss_pct", 1).alias("mss_pct"), "n_components")


@query(f"WITH {V.SQL_PAIRS} SELECT id, round(avg(p) - avg(o), 3) AS bias_mean, round(quantile_cont(p, 0.1) - quantile_cont(o, 0.1), 3) AS bias_p10, round(quantile_cont(p, 0.9) - quantile_cont(o, 0.9), 3) AS bias_p90 FROM pairs GROUP BY id")
def q_bias_percentiles(spark, d):
    return V.pairs(spark, d).groupBy("id").agg(r(F.avg("p") - F.avg("o"), 3).alias("bias_mean"), r(F.percentile("p", 0.1) - F.percentile("o", 0.1), 3).alias("bias_p10"), r(F.percentile("p", 0.9) - F.percentile("o", 0.9), 3).alias("bias_p90"))


@query(f"WITH {V.SQL_PAIRS}, b AS (SELECT id, avg(p) - avg(o) AS b FROM pairs GROUP BY id) SELECT round(median(b), 3) AS median, round(avg(abs(b)), 3) AS mae, round(sqrt(avg(b * b)), 3) AS rmse, round(avg(b), 3) AS mean, round(stddev_pop(b), 3) AS std FROM b")
def q_vc_eval(spark, d):
    b = V.pairs(spark, d).groupBy("id").agg((F.avg("p") - F.avg("o")).alias("b"))
    return b.agg(r(F.median("b"), 3).alias("median"), r(F.avg(F.abs("b")), 3).alias("mae"), r(F.sqrt(F.avg(F.col("b") * F.col("b"))), 3).alias("rmse"), r(F.avg("b"), 3).alias("mean"), r(F.stddev_pop("b"), 3).alias("std"))


@query(f"WITH {V.SQL_OBS} SELECT id, year, round({V.sql_mean('value', 9)}, 3) AS value, count(value) AS months FROM obs GROUP BY id, year")
def q_yearly_rollup(spark, d):
    return V.obs(spark, d).groupBy("id", "year").agg(r(_mean("value"), 3).alias("value"), F.count("value").alias("months"))


@query(f"WITH {V.SQL_OBS} SELECT id, CAST(floor(year / 10.0) * 10 AS INT) AS decade, round({V.sql_mean('value', 9)}, 3) AS value FROM obs GROUP BY ALL")
def q_decadal_rollup(spark, d):
    return V.obs(spark, d).groupBy("id", S.decade(F.col("year")).alias("decade")).agg(r(_mean("value"), 3).alias("value"))


_PERIODS = (("early", 1995, 1997), ("middle", 1996, 1999), ("late", 1999, 2001))
_BANDS = (("south", 15.0, 30.0), ("mid", 30.0, 45.0), ("north", 45.0, 60.0), ("arctic", 60.0, 75.0))


@query(f"WITH {V.SQL_OBS}, {V.SQL_META}, p(period, y0, y1) AS (VALUES {', '.join(map(str, _PERIODS))}), b(band, l0, l1) AS (VALUES {', '.join(map(str, _BANDS))}) SELECT period, band, round({V.sql_mean('value', 9)}, 3) AS value, count(*) AS n FROM obs JOIN meta USING (id) JOIN p ON year BETWEEN y0 AND y1 JOIN b ON lat >= l0 AND lat < l1 GROUP BY period, band")
def q_period_bands(spark, d):
    periods = F.explode(F.array_compact(F.array(*[F.when(F.col("year").between(a, b), F.lit(n)) for n, a, b in _PERIODS])))
    band = F.coalesce(*[F.when((F.col("lat") >= a) & (F.col("lat") < b), F.lit(n)) for n, a, b in _BANDS])
    rows = V.obs(spark, d).join(V.meta(spark, d), "id").withColumn("band", band).where("band IS NOT NULL").withColumn("period", periods)
    return rows.groupBy("period", "band").agg(r(_mean("value"), 3).alias("value"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.SQL_ESM}, w AS (SELECT cell, CASE WHEN year <= 1996 THEN 'a' WHEN year <= 1998 THEN 'b' ELSE 'c' END AS win, {V.sql_mean('value', 9)} AS m FROM esm GROUP BY ALL) SELECT cell, win, round(m, 4) AS mean, round(m - {V.sql_mean('m', 9, 'OVER (PARTITION BY cell)')}, 4) AS anomaly FROM w")
def q_window_anomaly(spark, d):
    win = F.when(F.col("year") <= 1996, "a").when(F.col("year") <= 1998, "b").otherwise("c")
    m = V.esm(spark, d).groupBy("cell", win.alias("win")).agg(_mean("value").alias("m"))
    return moving.anomaly(m, ["cell"], "m", "x", 9).select("cell", "win", r("m").alias("mean"), r("x").alias("anomaly"))


@query("""WITH g AS (SELECT CAST(l_orderkey % 2 AS INT) AS gcm, CAST(year(l_shipdate) AS INT) AS year, CAST(l_partkey % 96 AS INT) AS cell, avg(l_quantity) AS value, var_pop(l_quantity) AS s2 FROM lineitem GROUP BY ALL),
i AS (SELECT *, value - 1.96 * sqrt(s2) AS lo, value + 1.96 * sqrt(s2) AS hi FROM g), c AS (SELECT year, cell, avg(value) AS m, stddev_pop(value) AS s, avg(((hi - lo) / 2) ** 2) AS v FROM i GROUP BY year, cell)
SELECT year, cell, round(m, 4) AS mean, round(s, 4) AS gcm_spread, round(m - 1.96 * sqrt(v + s * s), 4) AS total_lo, round(m + 1.96 * sqrt(v + s * s), 4) AS total_hi FROM c""")
def q_ensemble_combine(spark, d):
    rows = V.table(spark, d, "lineitem").select((F.col("l_orderkey") % 2).alias("gcm"), F.year("l_shipdate").alias("year"), (F.col("l_partkey") % 96).cast("int").alias("cell"), "l_quantity")
    g = rows.groupBy("gcm", "year", "cell").agg(F.avg("l_quantity").alias("value"), F.var_pop("l_quantity").alias("s2"))
    lo, hi = S.normal_interval(F.col("value"), F.col("s2"))
    c = ensemble.combine(g.withColumn("pi_lo", lo).withColumn("pi_hi", hi), ["year", "cell"])
    return c.select("year", "cell", *[r(x).alias(x) for x in ("mean", "gcm_spread", "total_lo", "total_hi")])


@query(f"WITH {V.SQL_META}, x AS (SELECT CAST(unnest(range(200)) AS INT) AS k) SELECT k, round(15 + k * 60.0 / 199, 4) AS lat, round(avg(exp(-0.5 * power((15 + k * 60.0::DOUBLE / 199 - m.lat) / 2.0, 2)) / (2.0 * sqrt(2 * pi()))), 6) AS density FROM x CROSS JOIN meta m GROUP BY k")
def q_kde_lat(spark, d):
    # each station spreads over the points of a fixed axis, so the work is stations times 200
    at = F.lit(15) + F.col("k") * 60.0 / 199
    spread = V.meta(spark, d).select("lat", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k"))
    return spread.groupBy("k").agg(r(F.avg(F.exp(-0.5 * F.pow((at - F.col("lat")) / 2.0, 2)) / (2.0 * (2 * 3.141592653589793) ** 0.5)), 6).alias("density")).select("k", r(at).alias("lat"), "density")


@query("WITH s AS (SELECT 15 + (((s_suppkey % 40) * 7919) % 6000) / 100.0::DOUBLE AS y, -170 + (((s_suppkey % 40) * 104729) % 12000) / 100.0::DOUBLE AS x, s_acctbal AS value FROM supplier) SELECT round(x, 6) AS x, round(y, 6) AS y, round(avg(value), 4) AS value, count(value) AS stations FROM s GROUP BY round(x, 6), round(y, 6)")
def q_dedup_locations(spark, d):
    k = F.col("s_suppkey") % 40
    s = V.table(spark, d, "supplier").select((15 + ((k * 7919) % 6000) / 100.0).alias("y"), (-170 + ((k * 104729) % 12000) / 100.0).alias("x"), F.col("s_acctbal").alias("value"))
    return grids.merge_locations(s).withColumn("value", r("value"))


@query(f"WITH {V.SQL_PAIRS} SELECT id, round(avg(abs(p - o)), 3) AS mae, round(avg(CASE WHEN abs(p - o) > 1000 THEN 1.0 ELSE 0.0 END), 4) AS fraction FROM pairs GROUP BY id ORDER BY avg(abs(p - o)) DESC LIMIT 5")
def q_topk_worst(spark, d):
    g = V.pairs(spark, d).groupBy("id").agg(F.avg(F.abs(F.col("p") - F.col("o"))).alias("m"), F.avg((F.abs(F.col("p") - F.col("o")) > 1000).cast("double")).alias("f"))
    return g.orderBy(F.desc("m")).limit(5).select("id", r("m", 3).alias("mae"), r("f").alias("fraction"))


@query("WITH y AS (SELECT DISTINCT CAST(floor(year(o_orderdate) / 1.0) AS INT) AS year FROM orders), q(target) AS (VALUES (1993), (1996), (2005)) SELECT target, arg_min(year, abs(year - target) * 10000 + year) AS nearest FROM q CROSS JOIN y GROUP BY target")
def q_nearest_decade(spark, d):
    years = V.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.select("year", F.explode(F.array(F.lit(1993), F.lit(1996), F.lit(2005))).alias("target")).groupBy("target").agg(F.min_by("year", F.struct(F.abs(F.col("year") - F.col("target")), "year")).alias("nearest"))


@query(f"WITH {V.SQL_OBS}, a AS (SELECT DISTINCT id FROM obs WHERE year <= 1997 AND id % 3 <> 0), b AS (SELECT DISTINCT id FROM obs WHERE year > 1997 AND id % 4 <> 0) SELECT 'intersect' AS op, id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'except', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'union', id FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'union all', id FROM (SELECT id FROM a UNION ALL SELECT id FROM b)")
def q_set_ops(spark, d):
    o = V.obs(spark, d)
    a = o.where((F.col("year") <= 1997) & (F.col("id") % 3 != 0)).select("id").distinct()
    b = o.where((F.col("year") > 1997) & (F.col("id") % 4 != 0)).select("id").distinct()
    parts = {"intersect": a.intersect(b), "except": a.exceptAll(b), "union": a.union(b).distinct(), "union all": a.unionByName(b)}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("op"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {V.SQL_ESM}, m AS (SELECT cell, month, avg(value) AS mean FROM esm GROUP BY cell, month) SELECT e.year, e.month, CAST(k AS INT) AS pc, round(sum((e.value - m.mean) * (((e.cell * (k + 3)) % 11) - 5) / 10.0::DOUBLE), 4) AS score FROM esm e JOIN m USING (cell, month) CROSS JOIN (SELECT unnest(range(1, 4)) AS k) GROUP BY e.year, e.month, k")
def q_eof_projection(spark, d):
    from stratocline.operators.linear import project

    field = V.esm(spark, d).withColumnRenamed("year", "t")
    loadings = field.groupBy("cell", "month").agg(F.avg("value").alias("mean")).withColumn("pc", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("weight", ((F.col("cell") * (F.col("pc") + 3)) % 11 - 5) / 10.0)
    return project(field, loadings, ["month"]).select(F.col("t").alias("year"), "month", "pc", r("score").alias("score"))


@query(f"WITH {V.SQL_PAIRS} SELECT id, round(regr_slope(o, p), 4) AS slope, round(regr_intercept(o, p), 2) AS intercept, round(regr_r2(o, p), 6) AS r2, count(*) AS n FROM pairs GROUP BY id")
def q_ols_simple(spark, d):
    from stratocline.operators.linear import simple_ols

    return simple_ols(V.pairs(spark, d), ["id"], "p", "o").select("id", r("slope").alias("slope"), r("intercept", 2).alias("intercept"), r("r2", 6).alias("r2"), "n")


@query(f"""WITH {V.SQL_PAIRS}, m AS (SELECT id, count(*) AS n, avg(o) AS my, avg(p) AS m1, avg(month) AS m2, var_pop(p) AS s11, var_pop(month) AS s22, covar_pop(p, month) AS s12, covar_pop(p, o) AS s1y, covar_pop(month, o) AS s2y FROM pairs GROUP BY id),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / nullif(s11 * s22 - s12 * s12, 0) AS b1, (s11 * s2y - s12 * s1y) / nullif(s11 * s22 - s12 * s12, 0) AS b2 FROM m)
SELECT id, n, round(my - b1 * m1 - b2 * m2, 2) AS b0, round(b1, 4) AS b1, round(b2, 3) AS b2 FROM b""")
def q_ols_multi(spark, d):
    from stratocline.operators.linear import two_predictor_ols

    return two_predictor_ols(V.pairs(spark, d).withColumn("m", F.col("month").cast("double")), ["id"], "p", "m", "o").select("id", "n", r("b0", 2).alias("b0"), r("b1").alias("b1"), r("b2", 3).alias("b2"))


@query(f"""WITH {V.SQL_META}, k AS (SELECT a.id AS i, b.id AS j, exp(-((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) / (2 * 5.0 * 5.0)) AS k FROM meta a JOIN meta b ON a.id <> b.id AND (a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2 <= 900)
SELECT i, j, round(k / sum(k) OVER (PARTITION BY i) / 1.01, 6) AS w FROM k""")
def q_gauss_weights(spark, d):
    from stratocline.operators.noise import gaussian_weights

    s = V.meta(spark, d).select("id", F.col("lat").alias("x"), F.col("lon").alias("y"))
    return gaussian_weights(s, 5.0, reach=6.0, digits=6)


@query(f"SELECT event_type, count(value) AS n, count(DISTINCT user_id) AS users, round(min(value), 4) AS least, round(max(value), 4) AS most, round({V.sql_mean('value')}, 4) AS mean, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 4) AS missing FROM events GROUP BY event_type")
def q_profile_columns(spark, d):
    e = V.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("value").alias("n"), F.count_distinct("user_id").alias("users"), r(F.min("value")).alias("least"), r(F.max("value")).alias("most"), r(M.exact_mean(F.col("value"))).alias("mean"), r(F.avg(F.col("value").isNull().cast("double"))).alias("missing"))


@query(f"SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, round({V.sql_mean('value')}, 4) AS mean FROM events GROUP BY ALL")
def q_tumbling_events(spark, d):
    from stratocline.streaming.tumbling import tumbling_means

    return tumbling_means(V.table(spark, d, "events")).select("start", "event_type", "n", r("mean").alias("mean"))


@query(f"WITH {V.SQL_ESM} SELECT cell, year, month, CAST(CASE WHEN value IS NULL THEN -32768 ELSE round(value * 100) END AS SMALLINT) AS packed, round(CAST(round(value * 100) AS SMALLINT) * 0.01::DOUBLE, 2) AS back FROM esm")
def q_packed_values(spark, d):
    p = S.pack_hundredths(F.col("value"))
    return V.esm(spark, d).select("cell", "year", "month", p.alias("packed"), r(S.unpack_hundredths(p), 2).alias("back"))


@query(f"WITH {V.SQL_META} SELECT id, lat BETWEEN 25 AND 60 AND lon >= -150 + (lat - 25) * (20.0 / 35) AND lon < -60 - (lat - 25) * (30.0 / 35) AS inside FROM meta")
def q_point_in_polygon(spark, d):
    ring = [(25.0, -150.0), (25.0, -60.0), (60.0, -90.0), (60.0, -130.0)]
    return V.meta(spark, d).select("id", grids.point_in_rings(F.col("lat"), F.col("lon"), ring).alias("inside"))


@query(f"WITH {V.SQL_OBS} SELECT year, month, count(value) AS n, round({V.sql_mean('value', 9)}, 3) AS mean FROM obs WHERE value IS NOT NULL GROUP BY year, month HAVING count(value) >= CAST(0.05 * (SELECT count(DISTINCT id) FROM obs) AS INT)")
def q_timestep_counts(spark, d):
    o = V.obs(spark, d)
    least = o.agg((0.05 * F.count_distinct("id")).cast("int").alias("least"))
    g = o.groupBy("year", "month").agg(F.count("value").alias("n"), r(_mean("value"), 3).alias("mean"))
    return g.join(F.broadcast(least), F.col("n") >= F.col("least")).select("year", "month", "n", "mean")


@query(f"WITH {V.SQL_ESM} SELECT year, month, round({V.sql_mean('value', 9)}, 4) AS mean, count(value) AS cells FROM esm WHERE lat_idx BETWEEN 2 AND 5 AND lon_idx BETWEEN 3 AND 8 GROUP BY year, month")
def q_regional_mean(spark, d):
    inside = F.col("lat_idx").between(2, 5) & F.col("lon_idx").between(3, 8)
    return V.esm(spark, d).where(inside).groupBy("year", "month").agg(r(_mean("value")).alias("mean"), F.count("value").alias("cells"))


@query(f"WITH {V.SQL_PAIRS}, x AS (SELECT abs(p - o) AS a FROM pairs) SELECT round(quantile_cont(a, 0.95), 2) AS p95, round(quantile_cont(a, 0.99), 2) AS p99, round(max(a), 2) AS most, round(avg(CASE WHEN a <= 5000 THEN 1.0 ELSE 0.0 END), 4) AS within FROM x")
def q_diff_percentiles(spark, d):
    """Percentiles of one group of all rows, by histograms over all tasks."""
    x = V.pairs(spark, d).select(F.abs(F.col("p") - F.col("o")).alias("a"))
    ranks = exact_percentiles(x, [], "a", [0.95, 0.99, 1.0]).select("percentiles")
    shares = x.agg(F.avg((F.col("a") <= 5000).cast("double")).alias("within"))
    # one row beside one
    at = [r(F.col("percentiles")[i], 2).alias(n) for i, n in enumerate(("p95", "p99", "most"))]
    return ranks.crossJoin(F.broadcast(shares)).select(*at, r("within").alias("within"))


@query("""SELECT l_returnflag AS flag, count(*) AS n, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.05), 4) AS p05, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS p50,
round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag""")
def q_group_percentiles(spark, d):
    """Percentiles of few groups of very many rows."""
    out = exact_percentiles(V.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return out.select("flag", "n", *[r(F.col("percentiles")[i]).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


_RINGS = f"{V.SQL_META}, c AS (SELECT m.id, m.lat, m.lon, CAST(s_nationkey % 3 AS INT) AS polygon FROM meta m JOIN supplier ON s_suppkey = m.id), e AS (SELECT polygon, lat AS a_lat, lon AS a_lon, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS b_lat, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS b_lon FROM c WINDOW w AS (PARTITION BY polygon ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_CROSSED = "(a_lat > p.lat) <> (b_lat > p.lat) AND p.lon < (p.lat - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat)) + a_lon"
DEGREE_GRID = grids.GridSpec(15.0, 75.0, -170.0, -50.0, 1.0)


def _rings(spark, d):
    """Rings through the stations of some nations, in the order of ids; they cross themselves, parity tells inside from outside."""
    nations = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).cast("int").alias("polygon"))
    return raster.edges_of(V.meta(spark, d).join(nations, "id"), ["polygon"], "id")


@query(f"""WITH {_RINGS}, p AS (SELECT i, j, 15.0::DOUBLE + i * 1.0::DOUBLE AS lat, -170.0::DOUBLE + j * 1.0::DOUBLE AS lon FROM (SELECT unnest(range(61)) AS i) CROSS JOIN (SELECT unnest(range(121)) AS j))
SELECT polygon, CAST(i * 121 + j AS BIGINT) AS cell FROM p JOIN e ON {_CROSSED} GROUP BY polygon, i, j HAVING count(*) % 2 = 1""")
def q_polygon_raster(spark, d):
    return raster.rasterize(_rings(spark, d), ["polygon"], DEGREE_GRID).select("polygon", "cell")


@query(f"WITH {_RINGS}, p AS (SELECT c_custkey AS id, 15 + ((c_custkey * 7919 + 13) % 6000) / 100.0::DOUBLE AS lat, -170 + ((c_custkey * 104729 + 7) % 12000) / 100.0::DOUBLE AS lon FROM customer) SELECT polygon, p.id FROM p JOIN e ON {_CROSSED} GROUP BY polygon, p.id HAVING count(*) % 2 = 1")
def q_polygon_points(spark, d):
    k = F.col("c_custkey")
    points = V.table(spark, d, "customer").select(k.alias("id"), (15 + (k * 7919 + 13) % 6000 / 100.0).alias("lat"), (-170 + (k * 104729 + 7) % 12000 / 100.0).alias("lon"))
    return raster.points_inside(points, _rings(spark, d), ["polygon"])


@query(f"WITH {_FLAG_BASE}, {V.SQL_META} SELECT flag, count(*) AS stations, round(min(lat), 2) AS south, round(max(lat), 2) AS north FROM flagged JOIN meta USING (id) GROUP BY flag")
def q_flag_counts(spark, d):
    joined = _flags(spark, d)[1].join(V.meta(spark, d), "id")
    return joined.groupBy("flag").agg(F.count(F.lit(1)).alias("stations"), r(F.min("lat"), 2).alias("south"), r(F.max("lat"), 2).alias("north"))


@query(f"WITH {V.SQL_PAIRS}, {V.SQL_META}, s AS (SELECT arg_min(id, abs(lat - 45) * 1000000 + id) AS id FROM meta) SELECT year + (month - 0.5::DOUBLE) / 12 AS t, round(o, 6) AS obs, round(p, 6) AS pcr, round(e, 6) AS esm FROM pairs JOIN s USING (id) WHERE year BETWEEN 1996 AND 1998")
def q_station_series(spark, d):
    """Observed, predicted and model values of the station nearest to a latitude, over a window of years."""
    station = V.meta(spark, d).agg(F.min_by("id", F.struct(F.abs(F.col("lat") - 45), "id")).alias("s"))
    rows = V.pairs(spark, d).where("year BETWEEN 1996 AND 1998").join(F.broadcast(station), F.col("id") == F.col("s"))
    return rows.select((F.col("year") + (F.col("month") - 0.5) / 12).alias("t"), r("o", 6).alias("obs"), r("p", 6).alias("pcr"), r("e", 6).alias("esm"))


@query(f"WITH {V.SQL_PAIRS}, {V.SQL_META} SELECT id, year, month, round(lat, 2) AS lat, round(lon, 2) AS lon, round(p, 6) AS value, round(o, 6) AS obs, round(e, 6) AS esm FROM pairs JOIN meta USING (id) WHERE year IN {V.TEST_YEARS}")
def q_test_cache(spark, d):
    rows = V.pairs(spark, d).where(F.col("year").isin(*V.TEST_YEARS)).join(V.meta(spark, d), "id")
    return rows.select("id", "year", "month", r("lat", 2).alias("lat"), r("lon", 2).alias("lon"), r("p", 6).alias("value"), r("o", 6).alias("obs"), r("e", 6).alias("esm"))


@query(f"WITH {V.SQL_OBSQ} SELECT id, arg_min(round(value, 4), year * 12 + month) AS first_value, count(DISTINCT year) AS years FROM obs GROUP BY id")
def q_first_value(spark, d):
    return V.obs(spark, d, "l_quantity").groupBy("id").agg(F.min_by(r("value"), F.col("year") * 12 + F.col("month")).alias("first_value"), F.count_distinct("year").alias("years"))


@query(f"WITH {V.SQL_OBSQ}, {V.SQL_META}, a AS (SELECT year FROM obs GROUP BY year HAVING count(*) >= 900), b AS (SELECT year FROM esm GROUP BY year), {V.SQL_ESM} SELECT year FROM a INTERSECT SELECT year FROM b".replace(f"b AS (SELECT year FROM esm GROUP BY year), {V.SQL_ESM}", f"{V.SQL_ESM}, b AS (SELECT year FROM esm GROUP BY year)"))
def q_common_years(spark, d):
    full = V.obs(spark, d, "l_quantity").groupBy("year").agg(F.count(F.lit(1)).alias("n")).where("n >= 900").select("year")
    return full.intersect(V.esm(spark, d).select("year"))


#: Planned stations, grid rows and columns, years of the transient run; bytes a value.


@query("""WITH s AS (SELECT 'tas' AS var, count(*) AS n FROM supplier UNION ALL SELECT 'pr', count(*) FROM customer), m AS (SELECT count(DISTINCT l_partkey % 96) AS cells, count(DISTINCT date_trunc('month', l_shipdate)) AS months FROM lineitem)
SELECT var, n * months AS station_months, round(n * months * 4 / 1e9::DOUBLE, 9) AS station_gb, round(cells * months * 4 / 1e9::DOUBLE, 9) AS grid_gb FROM s CROSS JOIN m""")
def q_size_estimate(spark, d):
    """Bytes of the products of a run, single precision, from the numbers of stations, cells and months."""
    stations = [V.table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).withColumn("var", F.lit(v)) for v, t in (("tas", "supplier"), ("pr", "customer"))]
    run = V.table(spark, d, "lineitem").agg(F.count_distinct(F.col("l_partkey") % 96).alias("cells"), F.count_distinct(F.trunc("l_shipdate", "month")).alias("months"))
    months = F.col("n") * F.col("months")
    # two rows beside one
    both = stations[0].union(stations[1]).crossJoin(F.broadcast(run))
    return both.select("var", months.alias("station_months"), r(months * 4 / 1e9, 9).alias("station_gb"), r(F.col("cells") * F.col("months") * 4 / 1e9, 9).alias("grid_gb"))


@query(f"WITH {V.SQL_OBS}, {V.SQL_META}, n AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM (SELECT DISTINCT id FROM obs)) SELECT id, CAST(rank AS INT) AS rank FROM n WHERE rank <= 100")
def q_first_stations(spark, d):
    """The first hundred stations with observations in the order of their ids: the report's own limit."""
    ids = V.obs(spark, d).select("id").distinct().orderBy("id").limit(100)
    return ids.select("id", F.row_number().over(Window.orderBy("id")).alias("rank"))


@query(f"WITH {V.SQL_OBS}, {V.SQL_META} SELECT id, CAST(max(o.month) AS INT) AS month, round(arg_max(m.lat + o.month / 100.0::DOUBLE, o.month), 4) AS lat, round(arg_max(m.lon, o.month), 4) AS lon FROM obs o JOIN meta m USING (id) GROUP BY id")
def q_station_union(spark, d):
    """Stations of all monthly models together; the last month's coordinates count."""
    rows = V.obs(spark, d).select("id", "month").distinct().join(V.meta(spark, d), "id").withColumn("lat", F.col("lat") + F.col("month") / 100.0)
    return selection.station_union(rows).select("id", "month", r("lat").alias("lat"), r("lon").alias("lon"))


@query(
    f"WITH {V.SQL_ESM}, s AS (SELECT lat_idx, lon_idx, avg(CASE WHEN value > 25.5 THEN 1.0 ELSE 0.0 END) AS share FROM esm GROUP BY ALL), {_CELLS}, {SQL_AXES}, n AS (SELECT cell, CASE WHEN lat BETWEEN 15 AND 71 THEN (SELECT arg_min(i, abs(15.0 + 8 * i - lat) * 1000000 + i) FROM la) END AS i, "
    "CASE WHEN lon BETWEEN -170 AND -60 THEN (SELECT arg_min(j, abs(-170.0 + 10 * j - lon) * 1000000 + j) FROM lo) END AS j FROM cells) "
    "SELECT cell, coalesce(share > 0.5, FALSE) AS is_land FROM n LEFT JOIN s ON s.lat_idx = n.i AND s.lon_idx = n.j"
)
def q_mask_resample(spark, d):
    """The share of months above a bound on a coarse grid, taken by the nearest cell: land above a half, none beyond the mask's extent."""
    share = V.esm(spark, d).groupBy("lat_idx", "lon_idx").agg(F.avg((F.col("value") > 25.5).cast("double")).alias("share"))
    return grids.resample_mask(SMALL_GRID.cells(spark), share, V.LAT_AXIS, V.LON_AXIS).select("cell", "is_land")
