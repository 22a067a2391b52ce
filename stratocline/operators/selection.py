"""Filters, splits, flags and reshaping of station tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month sets of the seasons (the year overlaps all others).
SEASONS = {"Annual": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11), "DJF": (12, 1, 2)}


def in_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], pad: float = 0.0) -> DataFrame:
    return df.where(F.col("lat").between(lat[0] - pad, lat[1] + pad) & F.col("lon").between(lon[0] - pad, lon[1] + pad))


def in_years(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("year").between(first, last))


def with_records(df: DataFrame, least: int) -> DataFrame:
    """Rows of stations with ``least`` values or more: a partial count, then a semi join."""
    full = df.groupBy("id").agg(F.count("value").alias("n")).where(F.col("n") >= least).select("id")
    return df.join(full, "id", "left_semi")


def by_season(df: DataFrame) -> DataFrame:
    """Each row once for the year and once for its season."""
    named = [F.when(F.col("month").isin(*months), F.lit(name)) for name, months in SEASONS.items()]
    return df.withColumn("season", F.explode(F.array_compact(F.array(*named))))


def unpivot_months(df: DataFrame, prefix: str = "m") -> DataFrame:
    """(id, year, m1..m12) as (id, year, month, value)."""
    return df.unpivot(["id", "year"], [f"{prefix}{m}" for m in range(1, 13)], "name", "value").select("id", "year", F.substring("name", len(prefix) + 1, 2).cast("int").alias("month"), "value")


def pivot_months(df: DataFrame) -> DataFrame:
    """(id, year, month, value) as (id, year, m1..m12): conditional sums in one aggregate."""
    return df.groupBy("id", "year").agg(*[F.max(F.when(F.col("month") == m, F.col("value"))).alias(f"m{m}") for m in range(1, 13)])


def split_years(first: int, last: int, n_val: int, n_test: int, seed: int = 2026) -> dict[str, list[int]]:
    """A seeded permutation of the years: the first ``n_val`` validate, the next ``n_test`` test, the rest calibrate."""
    years = np.arange(first, last + 1)
    order = np.random.default_rng(seed).permutation(len(years))
    parts = {"val": order[:n_val], "test": order[n_val : n_val + n_test], "cal": order[n_val + n_test :]}
    return {role: sorted(int(y) for y in years[i]) for role, i in parts.items()}


def year_role(year: Column, roles: dict[str, list[int]], default: str = "cal") -> Column:
    out = F.lit(default)
    for role, years in roles.items():
        out = F.when(year.isin(*years), F.lit(role)).otherwise(out) if years else out
    return out


def station_flags(df: DataFrame, cal_years: list[int], min_remove: int, min_cal: int) -> DataFrame:
    """(id, n_cal, flag): by whole calibration years, removed below the one bound and test only below the other."""
    months = df.groupBy("id").agg(F.count(F.when(F.col("year").isin(*cal_years), F.col("value"))).alias("months"))
    n = F.floor(F.col("months") / 12)
    flag = F.when(n < min_remove, "removed").when(n < min_cal, "test_only").otherwise("cal")
    return months.select("id", n.cast("long").alias("n_cal"), flag.alias("flag"))


def flag_bounds(n_cal: int) -> tuple[int, int]:
    """The bounds of 20 and 30 of 76 years, scaled to ``n_cal`` years."""
    least = max(1, round(20 * n_cal / 76))
    return least, max(least + 1, round(30 * n_cal / 76))


def split_label(role: Column, flag: Column) -> Column:
    flag = F.coalesce(flag, F.lit("removed"))
    return F.when(flag == "removed", "removed").when(flag == "test_only", "test").otherwise(F.coalesce(role, F.lit("cal")))


def outer_diff(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Full outer join of two tables of ``value`` with where each row was found and whether values differ."""
    left = a.select(*keys, F.col("value").alias("left_value"), F.lit(True).alias("__l"))
    right = b.select(*keys, F.col("value").alias("right_value"), F.lit(True).alias("__r"))
    found = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    joined = left.join(right, keys, "full_outer")
    return joined.select(*keys, "left_value", "right_value", found.alias("found"), (F.abs(F.col("left_value") - F.col("right_value")) > tolerance).alias("differs"))


def station_union(rows: DataFrame) -> DataFrame:
    """One row per station of (id, month, lat, lon): the coordinates of its last month, in one partial aggregate."""
    last = rows.groupBy("id").agg(F.max(F.struct("month", "lat", "lon")).alias("z"))
    return last.select("id", "z.month", "z.lat", "z.lon")
