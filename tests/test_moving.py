import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocline.operators import moving


def series(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "id int, t int, value double")


def movmean(x, k):
    out = []
    for i in range(len(x)):
        part = x[max(0, i - k // 2) : i + (k - 1) // 2 + 1]
        part = part[~np.isnan(part)]
        out.append(part.mean() if len(part) else np.nan)
    return np.array(out)


@pytest.mark.parametrize("k", [5, 6, 30])
def test_moving_mean_shrinks_at_edges_and_skips_gaps(spark, k):
    x = np.random.default_rng(k).normal(size=80)
    x[[3, 4, 5, 40]] = np.nan
    df = series(spark, [None if np.isnan(v) else float(v) for v in x])
    w = moving.frame(["id"], ["t"], k)
    got = [r.m for r in df.select("t", moving.moving_mean(F.col("value"), w).alias("m")).orderBy("t").collect()]
    assert np.allclose([np.nan if g is None else g for g in got], movmean(x, k), equal_nan=True, atol=1e-12)
    long = [r.m for r in moving.long_moving_mean(df, ["id"], ["t"], "value", k, "m").orderBy("t").collect()]
    assert np.allclose([np.nan if g is None else g for g in long], movmean(x, k), equal_nan=True, atol=1e-10)


def test_single_value_has_no_deviation(spark):
    w = moving.frame(["id"], ["t"], 30)
    assert series(spark, [4.0]).select(moving.moving_std(F.col("value"), w).alias("s")).first().s == 0.0


def test_variance_correction_against_loops(spark):
    t = np.arange(200)
    rng = np.random.default_rng(1)
    p, e = 0.8 * np.sin(2 * np.pi * t / 100 + 0.3) + 1.2 * rng.normal(size=200), np.sin(2 * np.pi * t / 100) + 0.5 * rng.normal(size=200)

    def movstd(x, k):
        return np.array([np.std(x[max(0, i - k // 2) : i + (k - 1) // 2 + 1], ddof=1) for i in range(len(x))])

    mp, me = movmean(p, 30), movmean(e, 30)
    want = mp + (p - mp) * movstd(e - me, 30) / movstd(p - mp, 30)
    df = spark.createDataFrame([(1, int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(p, e))], "id int, t int, p double, e double")
    got = [r.c for r in moving.variance_correction(df, ["id"], ["t"], "p", "e", 30, "c").orderBy("t").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-9


def test_constant_prediction_keeps_its_value(spark):
    df = spark.createDataFrame([(1, i, 2.0, float(i)) for i in range(5)], "id int, t int, p double, e double")
    assert {r.c for r in moving.variance_correction(df, ["id"], ["t"], "p", "e", 3, "c").collect()} == {2.0}
