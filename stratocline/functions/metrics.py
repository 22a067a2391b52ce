"""Verification metrics as aggregate expressions; nulls are left out pairwise by the caller's filter."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def exact_mean(v: Column, digits: int = 4, window: WindowSpec | None = None) -> Column:
    """The mean of values taken to ``digits`` decimals: whole numbers are summed and divided once, so that no order of rows changes it.

    The halves of the whole numbers are summed apart, so that the sum of very many may pass 64 bits.
    """
    whole = F.rint(v * float(10**digits)).cast("long")
    sums = F.sum(F.shiftright(whole, 32)), F.sum(whole.bitwiseAND(F.lit(0xFFFFFFFF))), F.count(v)
    high, low, n = sums if window is None else [c.over(window) for c in sums]
    total = high.cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(19,0)")
    return total.cast("double") / n / float(10**digits)


def mean_bias(p: Column, o: Column) -> Column:
    return F.avg(p - o)


def mean_absolute_error(p: Column, o: Column) -> Column:
    return F.avg(F.abs(p - o))


def rmse(p: Column, o: Column) -> Column:
    return F.sqrt(F.avg((p - o) * (p - o)))


def safe_corr(p: Column, o: Column) -> Column:
    """Correlation from moments; null where either side is constant (the built-in one raises there)."""
    return F.try_divide(F.covar_pop(p, o), F.nullif(F.stddev_pop(p) * F.stddev_pop(o), F.lit(0.0)))


def kge(p: Column, o: Column, least: int = 1) -> Column:
    """Kling-Gupta efficiency; null for fewer than ``least`` pairs or an undefined part."""
    r = safe_corr(p, o)
    alpha = F.try_divide(F.stddev_pop(p), F.stddev_pop(o))
    beta = F.try_divide(F.avg(p), F.avg(o))
    return F.when(F.count(p) >= least, 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(beta - 1, 2)))


def r_squared(p: Column, o: Column) -> Column:
    return 1 - F.try_divide(F.sum((p - o) * (p - o)), F.nullif(F.var_pop(o) * F.count(o), F.lit(0.0)))


def skill(metric: Column, p: Column, e: Column) -> Column:
    """How far a prediction ``p`` is from a reference ``e`` towards perfection, null where that is undefined."""
    bias = 1 - F.try_divide(F.abs(p), F.abs(e))
    error = 1 - F.try_divide(p, e)
    score = F.try_divide(p - e, 1 - e)
    return F.when(metric == "MB", bias).when(metric == "MAE", error).when(metric.isin("KGE", "r"), score)
