"""Exact percentiles of groups of any size, by brackets that close in on the ranks asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocline.operators.steps import written

#: Points of a sketch and its accuracy, rows of a span that are sorted in one buffer, and spans that are broadcast (some 100 bytes each).
POINTS, ACCURACY, LEAF, BROADCAST_SPANS = 256, 4096, 10_000, 100_000


def _at(span: DataFrame, rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Rows beside the spans of their group that hold them."""
    named = span.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in span.columns if c not in keys])
    same = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(F.broadcast(named) if count <= BROADCAST_SPANS else named, same).drop(*[f"_{k}" for k in keys])


def _bracket(points: int) -> list[Column]:
    """The points of a sketch around the rank, two apart; the ends of the span where the rank is next to them."""
    share = F.floor((F.col("a.rank") - F.col("a.below")) * points / F.col("a.inside")).cast("int")
    low = F.when(share < 1, F.col("a.lo")).otherwise(F.get("b.points", share - 1))
    high = F.when(share + 2 > points, F.col("a.hi")).otherwise(F.get("b.points", share + 2))
    return [low.alias("low"), F.greatest(low, high).alias("high")]


def _matching(a: DataFrame, b: DataFrame, keys: list[str], condition: Column, columns: list[Column | str]) -> DataFrame:
    for k in keys:
        condition &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), condition).select(*[F.col(f"a.{k}").alias(k) for k in keys], *columns)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: Sequence[float], *, points: int = POINTS, leaf: int = LEAF) -> DataFrame:
    """(keys, n, percentiles): interpolated percentiles in the order of ``shares``, equal to the aggregate ``percentile``.

    The aggregate keeps every distinct value of a group in one buffer.  Here a sketch of the span that holds a rank brackets it,
    and the rows below, on, between and above the two values of the bracket are counted before the shuffle; what
    holds the rank is the next span, until it has one value or at most ``leaf`` rows.  The counts are exact, so the sketch
    decides the number of passes only: each leaves some 3 of ``points`` parts, however the values lie, and ties end at once.
    Null, NaN and infinite values take no part; a group without others has no row; null keys are a group.
    """
    keys_ = [*keys, "_all"]
    v = F.col(value).cast("double")
    rows = df.select(*keys, F.lit(0).alias("_all"), v.alias("v"))
    rows = written(rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs(F.col("v")) != float("inf"))))
    groups = written(rows.groupBy(*keys_).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")))
    position = F.array(*[F.lit(float(p)) for p in shares])
    ranks = F.array_distinct(F.flatten(F.transform(position, lambda p: F.array(F.floor(p * (F.col("n") - 1)), F.ceil(p * (F.col("n") - 1))))))
    # below: rows of the group under the span; inside: rows in it
    spans = groups.select(*keys_, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    done = []
    while True:
        spans = written(spans)
        wide = (F.col("inside") > leaf) & (F.col("lo") < F.col("hi"))
        done.append(spans.where(~wide))
        spans = spans.where(wide)
        count = spans.count()
        if not count:
            break
        same = (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
        grid = F.array(*[F.lit(i / points) for i in range(points + 1)])
        sketches = _at(spans.select(*keys_, "lo", "hi").distinct(), rows, keys_, count).groupBy(*keys_, "lo", "hi").agg(F.percentile_approx("v", grid, ACCURACY).alias("points"))
        spans = written(_matching(spans, sketches, keys_, same, [*[F.col(f"a.{c}").alias(c) for c in ("rank", "lo", "hi", "below", "inside")], *_bracket(points)]))
        ends = ["lo", "hi", "low", "high"]
        side = F.when(F.col("v") < F.col("low"), 0).when(F.col("v") == F.col("low"), 1).when(F.col("v") < F.col("high"), 2).when(F.col("v") == F.col("high"), 3).otherwise(4)
        parts = _at(spans.select(*keys_, *ends).distinct(), rows, keys_, count).groupBy(*keys_, *ends, side.alias("side"))
        parts = parts.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        # at most five rows a bracket
        parts = parts.withColumn("before", F.sum("c").over(Window.partitionBy(*keys_, *ends).orderBy("side")) - F.col("c"))
        for c in ("low", "high"):
            same &= F.col(f"a.{c}") == F.col(f"b.{c}")
        offset = F.col("a.rank") - F.col("a.below") - F.col("b.before")
        columns = [F.col("a.rank").alias("rank"), F.col("b.least").alias("lo"), F.col("b.most").alias("hi"), (F.col("a.below") + F.col("b.before")).alias("below"), F.col("b.c").alias("inside")]
        spans = _matching(spans, parts, keys_, same & (offset >= 0) & (offset < F.col("b.c")), columns)
    found = done[0]
    for other in done[1:]:
        found = found.union(other)
    known = found.where("lo = hi").select(*keys_, "rank", F.col("lo").alias("x"))
    leaves = found.where("lo < hi")
    sorted_ = _at(leaves.select(*keys_, "lo", "hi").distinct(), rows, keys_, leaves.count()).groupBy(*keys_, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    here = (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    picked = _matching(leaves, sorted_, keys_, here, [F.col("a.rank").alias("rank"), F.get("b.vs", (F.col("a.rank") - F.col("a.below")).cast("int")).alias("x")])
    order = known.union(picked).groupBy(*keys_).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("xs"))

    def between(p: Column) -> Column:
        at = p * (F.col("a.n") - 1)
        low, high = F.col("b.xs")[F.floor(at)], F.col("b.xs")[F.ceil(at)]
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    out = _matching(groups, order, keys_, F.lit(True), [F.col("a.n").alias("n"), F.transform(position, between).alias("percentiles")])
    return out.drop("_all")
