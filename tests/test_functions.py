import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratocline.functions import metrics as M
from stratocline.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_calendar(spark):
    m = S.months_of_ka(F.lit(-22.0))
    assert one(spark, S.year_of_months(m)) == -20050
    assert one(spark, S.month_of_months(F.lit(-240001))) == 12
    assert one(spark, S.year_of_months(F.lit(-240001))) == -20001
    assert one(spark, S.days_in_month(F.lit(1996), F.lit(2))) == 29
    assert one(spark, S.decade(F.lit(-15))) == -20
    assert one(spark, S.wrap_longitude(F.lit(200.0))) == -160.0


def test_links_and_intervals(spark):
    assert abs(one(spark, S.inverse_log_link(S.log_link(F.lit(5.0), F.lit(1.0)), F.lit(1.0))) - 5) < 1e-12
    lo, hi = S.normal_interval(F.lit(10.0), F.lit(4.0))
    assert abs(one(spark, lo) - 6.08) < 1e-12 and abs(one(spark, hi) - 13.92) < 1e-12
    lo, hi = S.lognormal_interval(F.lit(0.0), F.lit(1.0), F.lit(1.0))
    assert one(spark, lo) == 0.0 and abs(one(spark, hi) - (math.exp(-0.5 + 1.96) - 1)) < 1e-12


def test_albers_origin_and_equal_area(spark):
    x, y = S.albers(F.lit(23.0), F.lit(-96.0))
    assert abs(one(spark, x)) < 1e-6 and abs(one(spark, y)) < 1e-6


def test_packing(spark):
    df = spark.createDataFrame([(1.234,), (None,)], "v double")
    rows = df.select(S.pack_hundredths(F.col("v")).alias("p")).select("p", S.unpack_hundredths(F.col("p")).alias("v")).collect()
    assert [(r.p, r.v) for r in rows] == [(123, 1.23), (-32768, None)]


def test_metrics(spark):
    df = spark.createDataFrame([(float(i) + 1, float(i)) for i in range(10)], "p double, o double")
    r = df.agg(M.mean_bias(F.col("p"), F.col("o")).alias("mb"), M.mean_absolute_error(F.col("p"), F.col("o")).alias("mae"), M.kge(F.col("p"), F.col("o")).alias("kge"), M.rmse(F.col("p"), F.col("o")).alias("rmse")).first()
    assert (r.mb, r.mae, r.rmse) == (1.0, 1.0, 1.0)
    assert abs(r.kge - (1 - abs(5.5 / 4.5 - 1))) < 1e-12
    constant = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "p double, o double")
    assert constant.agg(M.kge(F.col("p"), F.col("o")).alias("k")).first().k is None
    assert np.isclose(one(spark, 100 * M.skill(F.lit("MAE"), F.lit(1.0), F.lit(2.0))), 50)


def test_means_of_sums_beyond_64_bits(spark):
    w = Window.partitionBy(F.lit(1))
    for v in (5e9, -5e9):
        df = spark.createDataFrame([(v,), (v,), (v + 3,), (None,)], "v double")
        assert abs(df.agg(M.exact_mean(F.col("v"), 9).alias("x")).first().x - v - 1) < 1e-5
        assert all(abs(r.x - v - 1) < 1e-5 for r in df.select(M.exact_mean(F.col("v"), 9, w).alias("x")).collect())
    assert spark.createDataFrame([(None,)], "v double").agg(M.exact_mean(F.col("v")).alias("x")).first().x is None
