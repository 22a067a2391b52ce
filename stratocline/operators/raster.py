"""Polygons as tables of edges: cells and points inside, by the parity of crossings."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocline.operators.grids import GridSpec
from stratocline.operators.steps import written

EDGE = ["a_lat", "a_lon", "b_lat", "b_lon"]
PARTS = 2048  # of an axis at most, as their bounds come to the driver


def edges_of(corners: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, a_lat, a_lon, b_lat, b_lon) of the rings (keys, ``order``, lat, lon); the last corner is joined with the first.

    Corners with a null coordinate are left out.
    """
    known = corners.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def following(c: str) -> Column:
        return F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"b_{c}")

    return known.select(*keys, F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), following("lat"), following("lon"))


def _spans(lat: Column) -> Column:
    return (F.col("a_lat") > lat) != (F.col("b_lat") > lat)


def _crossing(lat: Column) -> Column:
    return (lat - F.col("a_lat")) * ((F.col("b_lon") - F.col("a_lon")) / (F.col("b_lat") - F.col("a_lat"))) + F.col("a_lon")


def _steps(lo: Column, hi: Column, start: float, step: float, last: int) -> Column:
    """Whole numbers of an axis about lo to hi, one more at each end; who takes them tests each."""
    first = F.greatest(F.floor((lo - start) / step) - 1, F.lit(0))
    end = F.least(F.ceil((hi - start) / step) + 1, F.lit(last))
    return F.when(first <= end, F.sequence(first.cast("int"), end.cast("int")))


def rasterize(edges: DataFrame, keys: list[str], grid: GridSpec) -> DataFrame:
    """(keys, cell, lat_idx, lon_idx): cells of a grid whose point lies in the polygon of each key; further rings of a key are holes or parts.

    An edge is filed under the grid rows that it crosses; the crossings of a row, sorted, are ends of spans, and spans are
    filled.  Work grows with edges times rows crossed and with cells inside; a polygon's rows are in tasks of their own.
    A point on a western end is inside, one on an eastern end is not; so with southern and northern ends.
    """
    rows, columns = grid.shape
    lat = F.lit(grid.lat_min) + F.col("lat_idx") * grid.step
    lon = F.lit(grid.lon_min) + F.col("lon_idx") * grid.step
    filed = edges.where("a_lat <> b_lat").withColumn("lat_idx", F.explode(_steps(F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat"), grid.lat_min, grid.step, rows - 1)))
    crossed = filed.where(_spans(lat)).select(*keys, "lat_idx", _crossing(lat).alias("west"))
    w = Window.partitionBy(*keys, "lat_idx").orderBy("west")
    # a closed ring crosses each row an even number of times
    ends = crossed.select("*", F.lead("west").over(w).alias("east"), F.row_number().over(w).alias("k")).where("k % 2 = 1 AND west < east")
    cells = ends.withColumn("lon_idx", F.explode(_steps(F.col("west"), F.col("east"), grid.lon_min, grid.step, columns - 1)))
    inside = cells.where((lon >= F.col("west")) & (lon < F.col("east")))
    return inside.select(*keys, (F.col("lat_idx").cast("long") * columns + F.col("lon_idx")).alias("cell"), "lat_idx", "lon_idx")


def _in_parts(df: DataFrame, values: dict[str, str], cuts: list[float]) -> DataFrame:
    """``df`` with the number of the part between ``cuts`` that each value (by the name of the number) lies in; NaN is in one more."""
    made = Bucketizer(splitsArray=[cuts] * len(values), inputCols=list(values.values()), outputCols=list(values), handleInvalid="keep").transform(df)
    return made.withColumns({c: F.col(c).cast("int") for c in values})


def _met(places: DataFrame, edges: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """(keys, lat, lon) of the places west of an odd number of edges that pass east of their whole cell, and (keys, edge, lat, lon) of edges and places in the cells that an edge passes."""
    shares = [i / parts for i in range(1, parts)]
    lat_cuts, lon_cuts = ([-math.inf, *(sorted(v for v in set(q) if math.isfinite(v)) or [0.0]), math.inf] for q in places.approxQuantile(["lat", "lon"], shares, 0.25 / parts))
    dealt = _in_parts(_in_parts(places, {"lat_idx": "lat"}, lat_cuts), {"lon_idx": "lon"}, lon_cuts)
    rows = dealt.groupBy("lat_idx").agg(F.min("lat").alias("south"), F.max("lat").alias("north"))

    # an edge that stands twice changes nothing; few edges may make many rows, so they are spread over all tasks
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = edges.dropna(subset=EDGE).where("a_lat <> b_lat").repartition(tasks, *EDGE).groupBy(*keys, *EDGE).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")
    reach = single.withColumns({"lo": F.least("a_lat", "b_lat"), "hi": F.greatest("a_lat", "b_lat")})
    filed = _in_parts(reach, {"first": "lo", "last": "hi"}, lat_cuts).withColumn("lat_idx", F.explode(F.sequence("first", "last"))).join(F.broadcast(rows), "lat_idx").where("lo <= north AND hi > south")
    # doubles rounded or not, a crossing moves one way with latitude: the outermost ones of a row bound the others
    ends = [_crossing(F.greatest("lo", "south")), _crossing(F.least("hi", "north"))]
    bound = _in_parts(filed.withColumns({"west": F.least(*ends), "east": F.greatest(*ends)}), {"from": "west", "to": "east"}, lon_cuts)
    through = F.expr("lo <= south AND hi > north AND NOT isnan(east)")
    passing = bound.select(*keys, *EDGE, "lat_idx", F.when(through, F.col("from")).otherwise(0).alias("from"), "to")

    # cells before ``from`` are west of the edge as a whole: summed from the east, every second stretch of a row is odd
    turns = passing.where("from > 0").groupBy(*keys, "lat_idx", "from").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    w = Window.partitionBy(*keys, "lat_idx").orderBy(F.desc("from"))
    odd = turns.select(*keys, "lat_idx", "from", F.lead("from", 1, 0).over(w).alias("next"), F.row_number().over(w).alias("k")).where("k % 2 = 1")
    cells = odd.select(*keys, "lat_idx", F.explode(F.sequence(F.col("next"), F.col("from") - 1)).alias("lon_idx"))
    near = passing.select(*keys, *EDGE, "lat_idx", F.explode(F.sequence("from", "to")).alias("lon_idx"))
    return tuple(df.join(dealt, ["lat_idx", "lon_idx"]).drop("lat_idx", "lon_idx") for df in (cells, near))


def points_inside(points: DataFrame, edges: DataFrame, keys: list[str], point_id: str = "id", crowd: int = 16) -> DataFrame:
    """(keys, point id): points (point id, lat, lon) in the polygon of each key.

    Places of points, each once, are dealt to a grid between quantiles of latitude and of longitude, some ``crowd`` to a
    cell.  An edge east of a whole cell is counted for the cell, and only the places of cells that it passes, or in whose
    row it ends, are tested one by one: work grows with edges times the root of places.  Points without a place are in none.
    """
    placed = points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").select(point_id, "lat", "lon")
    places = written(placed.select("lat", "lon").distinct())
    parts = min(max(math.ceil(math.sqrt(places.count() / crowd)), 2), PARTS)
    whole, near = _met(places, edges, keys, parts)
    crossed = near.where(_spans(F.col("lat")) & (F.col("lon") < _crossing(F.col("lat")))).select(*keys, "lat", "lon")

    def odd(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(*keys, *by)

    # rows of one id are counted together
    return odd(odd(whole.unionByName(crossed), "lat", "lon").join(placed, ["lat", "lon"]), point_id)
