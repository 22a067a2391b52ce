"""Moving frames over ordered months: means, deviations, variance correction, delta change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocline.functions.metrics import exact_mean


def frame(keys: list[str], order: list[str], k: int):
    """``k`` rows: k // 2 before, (k - 1) // 2 after, fewer at the edges."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k // 2), (k - 1) // 2)


def moving_mean(v: Column, window) -> Column:
    return F.avg(v).over(window)


def moving_std(v: Column, window) -> Column:
    """Sample deviation; 0 over a single value."""
    return F.when(F.count(v).over(window) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v).over(window))


def long_moving_mean(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, out: str) -> DataFrame:
    """The same mean for wide frames: differences of running sums, so that a row costs the same for any ``k``.

    The running sum is of anomalies from the key's mean, which keeps its digits.
    """
    whole, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order)
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = k // 2, (k - 1) // 2
    names = ["__mean", "__n", "__s", "__c"]
    df = df.withColumn("__mean", F.avg(value).over(whole)).withColumn("__n", F.count(F.lit(1)).over(whole))
    df = df.withColumn("__s", F.sum(F.coalesce(F.col(value) - F.col("__mean"), F.lit(0.0))).over(upto)).withColumn("__c", F.count(value).over(upto))
    last = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.currentRow, after)
    s = F.last("__s").over(last) - F.coalesce(F.lag("__s", before + 1).over(run), F.lit(0.0))
    c = F.last("__c").over(last) - F.coalesce(F.lag("__c", before + 1).over(run), F.lit(0))
    return df.withColumn(out, F.col("__mean") + F.try_divide(s, c.cast("double"))).drop(*names)


def variance_correction(df: DataFrame, keys: list[str], order: list[str], predicted: str, reference: str, k: int, out: str) -> DataFrame:
    """``predicted`` with the moving deviation of ``reference``: one partitioning and one sort for all frames.

    The ratio of deviations is 1 where it is undefined; a null prediction stays null.
    """
    w = frame(keys, order, k)
    df = df.withColumn("__mp", moving_mean(F.col(predicted), w)).withColumn("__me", moving_mean(F.col(reference), w))
    df = df.withColumn("__ap", F.col(predicted) - F.col("__mp")).withColumn("__ae", F.col(reference) - F.col("__me"))
    ratio = F.coalesce(F.try_divide(moving_std(F.col("__ae"), w), F.nullif(moving_std(F.col("__ap"), w), F.lit(0.0))), F.lit(1.0))
    return df.withColumn(out, F.col("__mp") + F.col("__ap") * ratio).drop("__mp", "__me", "__ap", "__ae")


def trailing_rescale(df: DataFrame, keys: list[str], order: list[str], predicted: str, reference: str, k: int, out: str) -> DataFrame:
    """``predicted`` times the ratio of trailing population deviations over ``k`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k - 1), Window.currentRow)
    ratio = F.try_divide(F.stddev_pop(reference).over(w), F.nullif(F.stddev_pop(predicted).over(w), F.lit(0.0)))
    return df.withColumn(out, F.col(predicted) * ratio)


def delta_change(df: DataFrame, keys: list[str], order: list[str], value: str, calibration: Column, k: int, out: str, *, log: bool = False) -> DataFrame:
    """Moving mean less the calibration mean; with ``log`` of ln(value + 1 + least calibration value)."""
    whole = Window.partitionBy(*keys)
    v = F.col(value)
    if log:
        df = df.withColumn("__v", F.ln(v + 1 + F.min(F.when(calibration, v)).over(whole)))
    else:
        df = df.withColumn("__v", v)
    base = F.avg(F.when(calibration, F.col("__v"))).over(whole)
    return df.withColumn(out, moving_mean(F.col("__v"), frame(keys, order, k)) - base).drop("__v")


def anomaly(df: DataFrame, keys: list[str], value: str, out: str, digits: int | None = None) -> DataFrame:
    """``value`` less the mean of its key; with ``digits`` that mean is the same for any order of rows."""
    whole = Window.partitionBy(*keys)
    return df.withColumn(out, F.col(value) - (F.avg(value).over(whole) if digits is None else exact_mean(F.col(value), digits, whole)))
