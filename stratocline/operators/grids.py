"""Axes, masks, nearest lookups and regridding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.operators.nearest import k_nearest


@dataclass(frozen=True)
class GridSpec:
    """An edge-registered grid; row and column i lie at least + i * step."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    step: float = 0.20

    @property
    def shape(self) -> tuple[int, int]:
        return tuple(int(np.floor((hi - lo) / self.step + 1e-9)) + 1 for lo, hi in ((self.lat_min, self.lat_max), (self.lon_min, self.lon_max)))

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, lat_idx, lon_idx, lat, lon), generated in the tasks; cell = lat_idx * columns + lon_idx."""
        rows, columns = self.shape
        i, j = (F.col("id") / columns).cast("int"), F.pmod("id", F.lit(columns)).cast("int")
        return spark.range(rows * columns).select(F.col("id").alias("cell"), i.alias("lat_idx"), j.alias("lon_idx"), (F.lit(self.lat_min) + i * self.step).alias("lat"), (F.lit(self.lon_min) + j * self.step).alias("lon"))


#: The production grid.
NORTH_AMERICA = GridSpec(15.0, 75.0, -170.0, -50.0)


def nearest_index(x: Column, axis: Sequence[float]) -> Column:
    """The index of the nearest value of an axis; the first of equally near ones; null for null.

    An axis is metadata of a few hundred values and becomes a literal of the expression.
    """
    distances = F.transform(F.array(*[F.lit(float(a)) for a in axis]), lambda a, i: F.struct(F.abs(a - x).alias("d"), i.alias("i")))
    return F.when(x.isNotNull(), F.array_min(distances)["i"])


def nearest_index_within(x: Column, axis: Sequence[float]) -> Column:
    """The same, but null beyond the ends of the axis."""
    return F.when(x.between(float(min(axis)), float(max(axis))), nearest_index(x, axis))


def at_nearest_cell(points: DataFrame, field: DataFrame, lat_axis: Sequence[float], lon_axis: Sequence[float], keys: list[str]) -> DataFrame:
    """Points joined with the field of their nearest cell, on the cell's indexes and ``keys``."""
    placed = points.withColumn("lat_idx", nearest_index(F.col("lat"), lat_axis)).withColumn("lon_idx", nearest_index(F.col("lon"), lon_axis))
    return placed.join(field, ["lat_idx", "lon_idx", *keys])


def masked(df: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """``value`` on land, null elsewhere; mask: (lat_idx, lon_idx, is_land)."""
    joined = df.join(mask, ["lat_idx", "lon_idx"], "left")
    return joined.withColumn(value, F.when(F.coalesce("is_land", F.lit(False)), F.col(value))).drop("is_land")


def nearest_station(points: DataFrame, stations: DataFrame, point_id: str = "cell") -> DataFrame:
    """(point id, id): the station nearest in the plane of columns x and y, the smallest id of equally near ones."""
    return k_nearest(points, stations.select("id", "x", "y"), 1, point_id).select(point_id, F.col("near")[0]["id"].alias("id"))


def merge_locations(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row per place: the mean value of stations whose x and y agree to ``digits`` decimals."""
    return df.groupBy(F.round("x", digits).alias("x"), F.round("y", digits).alias("y")).agg(F.avg("value").alias("value"), F.count("value").alias("stations"))


def point_in_rings(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies in a ring of (lat, lon) corners: parity of crossings, as one expression.

    A point on an edge along a latitude is inside, from the western end up to the eastern one, which is not.  Other edges
    run northward whatever the order of the corners, so that rings on both sides of one see the same crossing.
    """
    crossings, along = F.lit(0), F.lit(False)
    for (a_lat, a_lon), (b_lat, b_lon) in (sorted(e) for e in zip(ring, [*ring[1:], ring[0]])):
        if a_lat == b_lat:
            along = along | ((lat == a_lat) & (lon >= a_lon) & (lon < b_lon))
            continue
        spans = (F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)
        at = (lat - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat)) + a_lon
        crossings = crossings + F.when(spans & (lon < at), 1).otherwise(0)
    return along | (crossings % 2 == 1)


def resample_mask(cells: DataFrame, share: DataFrame, lat_axis: Sequence[float], lon_axis: Sequence[float]) -> DataFrame:
    """(cell, is_land): whether the nearest value of (lat_idx, lon_idx, share) is above a half; false beyond the axes and for null."""
    lat, lon = (nearest_index_within(F.col(c), axis) for c, axis in (("lat", lat_axis), ("lon", lon_axis)))
    placed = cells.select("cell", lat.alias("lat_idx"), lon.alias("lon_idx"))
    return placed.join(share, ["lat_idx", "lon_idx"], "left").select("cell", F.coalesce(F.col("share") > 0.5, F.lit(False)).alias("is_land"))
