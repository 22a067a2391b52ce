"""Two tables of one quantity held against each other: rows of one side, values that differ, where they gather and how far they are apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocline.functions import metrics as M
from stratocline.functions import scalars as S
from stratocline.operators.percentiles import exact_percentiles
from stratocline.operators.selection import outer_diff

#: Share of the second value that a difference may have beside the absolute tolerance.
RELATIVE = 1e-5


def compared(a: DataFrame, b: DataFrame, keys: list[str], absolute: float, relative: float = RELATIVE) -> DataFrame:
    """(keys, left_value, right_value, found, gap, differs) of two tables (keys, value), one shuffle of each.

    A row on both sides differs unless its gap is within ``absolute + relative * |right|``; where a value is null or NaN
    the gap is null and the row differs. Rows of one side have neither.
    """
    rows = outer_diff(a, b, keys, absolute)
    left, right = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("left_value", "right_value"))
    both = F.col("found") == "both"
    gap = F.when(both, F.abs(left - right))
    differs = F.when(both, F.coalesce(gap > F.lit(absolute) + F.lit(relative) * F.abs(right), F.lit(True)))
    return rows.withColumn("gap", gap).withColumn("differs", differs)


def differences_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, matched, total, n_diff, fraction): rows on both sides and on either, those that differ and their share of all, in one partial aggregate."""
    counts = rows.groupBy(*keys).agg(F.count_if(F.col("found") == "both").alias("matched"), F.count(F.lit(1)).alias("total"), F.count_if("differs").alias("n_diff"))
    return counts.withColumn("fraction", F.col("n_diff") / F.col("total"))


def differences_by_decade(rows: DataFrame) -> DataFrame:
    """(decade, n_diff) of the rows that differ; decades without any are absent."""
    return rows.where("differs").groupBy(S.decade(F.col("year")).alias("decade")).agg(F.count(F.lit(1)).alias("n_diff"))


def spread(differences: DataFrame) -> DataFrame:
    """One row from ``differences_by``: how many groups there are, equal ones, differing ones, and those that differ in more than half of their rows."""
    return differences.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n_diff") == 0).alias("equal"), F.count_if(F.col("n_diff") > 0).alias("differing"), F.count_if(F.col("fraction") > 0.5).alias("mostly"))


def parity(rows: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """(keys, n, largest, mean, median, limits...) of the gaps: exact, groups of any size; ``limits`` names the share of gaps above each."""
    gaps = rows.where("gap IS NOT NULL").select(*keys, "gap")
    over = [(F.count_if(F.col("gap") > limit) / F.count(F.lit(1))).alias(name) for name, limit in limits.items()]
    one = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("largest"), M.exact_mean(F.col("gap"), 9).alias("mean"), *over)
    middle = exact_percentiles(gaps, keys, "gap", [0.5]).select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("percentiles")[0].alias("median"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"m_{k}"))
    return one.join(middle, same).select(*keys, "n", "largest", "mean", "median", *limits)
