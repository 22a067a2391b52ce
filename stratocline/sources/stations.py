"""Station archives: fixed-width monthly files, per-station CSV files, and their Parquet form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocline.functions.scalars import tenths_per_month_to_daily
from stratocline.operators.selection import with_records

# Columns of the fixed-width files (first place from 1, width), and the bound below which a value is missing.
METADATA = {"id": (1, 11), "lat": (13, 8), "lon": (22, 9), "elev": (32, 7), "name": (39, 62)}
ID, YEAR, FIRST_VALUE, VALUE_WIDTH, VALUE_STEP, MISSING = (1, 11), (12, 4), 20, 5, 8, -99.9899

#: Columns of the per-station precipitation files, which have no header.
CSV_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("elev", T.DoubleType()),
    T.StructField("yyyymm", T.IntegerType()), T.StructField("raw", T.DoubleType()), T.StructField("mflag", T.StringType()), T.StructField("qflag", T.StringType()), T.StructField("sflag", T.StringType()), T.StructField("src", T.StringType()),
])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat, lon, elev, name) from a fixed-width inventory; unreadable numbers are null."""
    def part(name):
        return F.trim(F.substring("value", *METADATA[name]))
    return spark.read.text(path).where(F.trim("value") != "").select(part("id").alias("id"), *[part(c).try_cast("double").alias(c) for c in ("lat", "lon", "elev")], part("name").alias("name"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """(id, year, month, value) from fixed-width lines of twelve values in hundredths; missing ones are null."""
    line = F.col("value")
    months = [F.struct(F.lit(m).alias("month"), (F.trim(F.substring(line, FIRST_VALUE + VALUE_STEP * (m - 1), VALUE_WIDTH)).try_cast("double") / 100).alias("v")) for m in range(1, 13)]
    rows = spark.read.text(path).where(F.trim(line) != "").select(F.trim(F.substring(line, *ID)).alias("id"), F.trim(F.substring(line, *YEAR)).try_cast("int").alias("year"), F.explode(F.array(*months)).alias("m"))
    return rows.select("id", "year", "m.month", F.when(F.col("m.v") > MISSING, F.col("m.v")).alias("value"))


def load_temperature(spark: SparkSession, observations: str, inventory: str) -> DataFrame:
    """Observations with the place of their station; rows without a value are dropped."""
    return read_observations(spark, observations).where(F.col("value").isNotNull()).join(read_metadata(spark, inventory).drop("name"), "id", "left")


def load_precipitation(spark: SparkSession, folder: str, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None) -> DataFrame:
    """mm a day from per-station CSV files in tenths of mm a month; unreadable files are skipped."""
    raw = spark.read.schema(CSV_SCHEMA).option("quote", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreCorruptFiles", True).csv(folder)
    if lat and lon:
        raw = raw.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    year, month = F.floor(F.col("yyyymm") / 100).cast("int"), F.pmod("yyyymm", F.lit(100)).cast("int")
    rows = raw.where(F.col("id").isNotNull() & month.between(1, 12)).select("id", year.alias("year"), month.alias("month"), "raw", "lat", "lon", "elev")
    return rows.withColumn("value", tenths_per_month_to_daily(F.col("raw"), F.col("year"), F.col("month"))).drop("raw")


def station_places(observations: DataFrame) -> DataFrame:
    """One row per station: the place of its earliest observation."""
    return observations.groupBy("id").agg(F.min_by(F.struct("lat", "lon", "elev"), F.struct("year", "month")).alias("p")).select("id", "p.*")


def prepare(observations: DataFrame, lat: tuple[float, float], lon: tuple[float, float], first: int, last: int, min_years: int = 20) -> DataFrame:
    """Box, years and least record, in this order."""
    inside = observations.where(F.col("lat").between(*lat) & F.col("lon").between(*lon) & F.col("year").between(first, last))
    return with_records(inside, 12 * min_years)


def write_store(observations: DataFrame, folder: str) -> None:
    """Observations by month, and station places, as Parquet."""
    observations.write.mode("overwrite").partitionBy("month").option("compression", "zstd").parquet(f"{folder}/obs")
    station_places(observations).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/meta")
