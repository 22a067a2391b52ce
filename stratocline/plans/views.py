"""Station, model and pair tables derived from the driver's tables, as DataFrames and as SQL.

Monthly supplier shipments stand for station observations, part groups for model
cells; coordinates follow from keys by integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratocline.functions.metrics import exact_mean

LAT_AXIS = [15.0 + 8 * i for i in range(8)]
LON_AXIS = [-170.0 + 10 * j for j in range(12)]
TEST_YEARS, VAL_YEARS = (1997, 2000), (1998,)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str, value: str = "l_extendedprice") -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), value)
    return rows.groupBy("id", "year", "month").agg(exact_mean(F.col(value)).alias("value"))


def obs_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).withColumn("value", F.when((F.col("id") * 31 + F.col("year") * 12 + F.col("month")) % 7 != 0, F.col("value")))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (15 + ((k * 7919) % 6000) / 100.0).alias("lat"), (-170 + ((k * 104729) % 12000) / 100.0).alias("lon"))


def esm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = (F.col("l_partkey") % 96).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), cell.alias("cell"), "l_quantity")
    return rows.groupBy("year", "month", "cell").agg(exact_mean(F.col("l_quantity")).alias("value")).select("year", "month", "cell", F.floor(F.col("cell") / 12).cast("int").alias("lat_idx"), (F.col("cell") % 12).alias("lon_idx"), "value")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations ``o`` with a smoothed self ``p`` and the station's mean of that month ``e``."""
    o = obs(spark, sf_dir)
    w = Window.partitionBy("id").orderBy("year", "month").rowsBetween(-15, 14)
    climate = Window.partitionBy("id", "month")
    return o.select("id", "year", "month", F.col("value").alias("o"), F.avg("value").over(w).alias("p"), F.avg("value").over(climate).alias("e"))




def sql_mean(v: str, digits: int = 4, over: str = "") -> str:
    """SQL of ``exact_mean``, over a window where one is given."""
    return f"CAST(sum(CAST(round_even({v} * 1e{digits}::DOUBLE, 0) AS BIGINT)) {over} AS DOUBLE) / count({v}) {over} / 1e{digits}::DOUBLE"


SQL_OBS = f"obs AS (SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, {sql_mean('l_extendedprice')} AS value FROM lineitem GROUP BY ALL)"
SQL_OBSQ = f"obs AS (SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, {sql_mean('l_quantity')} AS value FROM lineitem GROUP BY ALL)"
SQL_META = "meta AS (SELECT s_suppkey AS id, 15 + ((s_suppkey * 7919) % 6000) / 100.0::DOUBLE AS lat, -170 + ((s_suppkey * 104729) % 12000) / 100.0::DOUBLE AS lon FROM supplier)"
SQL_ESM = f"esm AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, CAST(l_partkey % 96 AS INT) AS cell, CAST((l_partkey % 96) // 12 AS INT) AS lat_idx, CAST(l_partkey % 96 % 12 AS INT) AS lon_idx, {sql_mean('l_quantity')} AS value FROM lineitem GROUP BY ALL)"
SQL_PAIRS = SQL_OBS + ", pairs AS (SELECT id, year, month, value AS o, avg(value) OVER (PARTITION BY id ORDER BY year, month ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS p, avg(value) OVER (PARTITION BY id, month) AS e FROM obs)"
SQL_SEASONS = "seasons(season, month) AS (SELECT 'Annual', unnest(range(1, 13)) UNION ALL SELECT 'MAM', unnest([3, 4, 5]) UNION ALL SELECT 'JJA', unnest([6, 7, 8]) UNION ALL SELECT 'SON', unnest([9, 10, 11]) UNION ALL SELECT 'DJF', unnest([12, 1, 2]))"
