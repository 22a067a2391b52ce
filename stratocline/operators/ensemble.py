"""Combining models, and skill-score summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocline.functions.metrics import skill
from stratocline.functions.scalars import Z95


def combine(df: DataFrame, keys: list[str]) -> DataFrame:
    """Over models with value, pi_lo, pi_hi: mean, spread between models, and bounds of total variance."""
    half = (F.col("pi_hi") - F.col("pi_lo")) / 2
    one = df.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("gcm_spread"), F.avg(half * half).alias("stat_var"))
    total = F.sqrt(F.col("stat_var") + F.col("gcm_spread") * F.col("gcm_spread"))
    return one.select(*keys, "mean", "gcm_spread", (F.col("mean") - Z95 * total).alias("total_lo"), (F.col("mean") + Z95 * total).alias("total_hi"))


def mean_skill(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean skill in percent of (keys, metric, p, e): a metric weighs its mean |e|."""
    scored = metrics.withColumn("score", skill(F.col("metric"), F.col("p"), F.col("e"))).where("score IS NOT NULL")
    weights = scored.groupBy(*keys, "metric").agg(F.avg(F.abs("e")).alias("weight"))
    joined = scored.join(weights, [*keys, "metric"])
    total = F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight"))
    return joined.groupBy(*keys).agg((100 * total).alias("mss_pct"), F.count(F.lit(1)).alias("n_components"))
