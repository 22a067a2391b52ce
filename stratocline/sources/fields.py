"""Model fields and gridded products."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocline.functions import scalars as S

#: Units of the two kinds of model output: thousands of years before 1950 and m/s, or model years and kg/m2/s.
KINDS = ("ka", "model_year")


def open_store(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by the ending of its path; array files need a library that is not a part of this engine.

    CSV has a header; with ``schema`` its columns are typed, found by their names whatever their order, and only
    those that are used are parsed. Without, all are strings.
    """
    if re.search(r"\.(nc4?|zarr)/?$", path):
        raise ValueError(f"{path}: convert array files to Parquet cells first")
    if path.endswith((".csv", ".csv.gz")):
        if schema is None:
            return spark.read.option("header", True).csv(path)
        # the files' own order of columns, from the first header that is read
        head = spark.read.option("header", True).csv(path).columns
        types = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
        missing = [n for n in types if n not in head]
        if missing:
            raise ValueError(f"{path}: no columns {missing}")
        whole = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in head])
        return spark.read.option("header", True).option("enforceSchema", False).schema(whole).csv(path).select(*types)
    if path.endswith(".orc"):
        return spark.read.orc(path)
    return spark.read.parquet(path)


def files_of_years(paths: list[str], first: int, last: int) -> list[str]:
    """Paths whose name ends in a span _YYYYYMM-YYYYYMM that overlaps model years first to last; others are kept."""
    kept = []
    for p in paths:
        m = re.search(r"_(\d{5})\d{2}-(\d{5})\d{2}", p)
        if not m or int(m[1]) <= last and int(m[2]) >= first:
            kept.append(p)
    return kept


def normalise(raw: DataFrame, kind: str, variable: str, *others: str) -> DataFrame:
    """(year, month, lat, lon, value, others...) of raw cells (time or model_year and month, lat, lon, value): CE years, Celsius or mm a day, -180..180."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if kind == "ka":
        m = S.months_of_ka(F.col("time"))
        year, month = S.year_of_months(m), S.month_of_months(m)
    else:
        year, month = S.model_year_to_ce(F.col("model_year")).cast("int"), F.col("month").cast("int")
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    v = S.kelvin_to_celsius(v) if variable == "tas" else S.rate_to_mm_per_day(v, metres=kind == "ka")
    return raw.select(year.alias("year"), month.alias("month"), "lat", S.wrap_longitude(F.col("lon")).alias("lon"), v.alias("value"), *others)


def files_below(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files below a folder on any file system, in order; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").collect()
    return sorted(row["path"] for row in found)


def load_run(spark: SparkSession, folders: dict[str, str], kind: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(variable, year, month, lat, lon, value, file) of a run: ``folders`` names each variable's folder of Parquet files of raw cells.

    Of files whose names end in a span of model years only those that overlap the years first to last (CE) are
    opened; their rows all stay, other years included, as do files without a span.  A variable without such files brings
    no rows, one without any file is an error.  No shuffle.
    """
    parts = []
    for variable, folder in folders.items():
        paths = files_below(spark, folder)
        if not paths:
            raise FileNotFoundError(f"{folder}: no files of {variable}")
        low, high = (end if year is None else year + S.MODEL_YEAR_OFFSET for year, end in ((first, 0), (last, 99_999)))
        kept = files_of_years(paths, low, high)
        raw = spark.read.parquet(*(kept or paths[:1]))
        if not kept:
            raw = raw.limit(0)
        raw = raw.select("*", F.col("_metadata.file_path").alias("__file"))
        cells = normalise(raw, kind, variable, "__file")
        parts.append(cells.select(F.lit(variable).alias("variable"), "year", "month", "lat", "lon", "value", F.col("__file").alias("file")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def joined(run: DataFrame, variables: list[str]) -> DataFrame:
    """(year, month, lat, lon, variables...): a row per cell and month that any variable has, null where one lacks it.

    One partial aggregate, so each variable crosses one shuffle at most.  Where files overlap, the value of the file
    that is last by name counts, of repeated rows in it the greatest.
    """
    last = [F.max_by("value", F.when(F.col("variable") == v, F.struct("file", "value"))).alias(v) for v in variables]
    return run.where(F.col("variable").isin(*variables)).groupBy("year", "month", "lat", "lon").agg(*last)


def window(field: DataFrame, lat: tuple[float, float] = (7.0, 75.0), lon: tuple[float, float] = (-180.0, -50.0), pad: float = 5.0) -> DataFrame:
    return field.where(F.col("lat").between(lat[0] - pad, lat[1] + pad) & F.col("lon").between(lon[0] - pad, lon[1] + pad))


def read_matrices(spark: SparkSession, path: str, dtype: str = "<f4") -> DataFrame:
    """(path, row, col, value) of binary matrices: two 32-bit sizes, then values by row."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = content.as_py()
                rows, cols = (int(x) for x in np.frombuffer(raw, "<i4", 2))
                value = np.frombuffer(raw, dtype, rows * cols, 8).astype(float)
                r, c = np.divmod(np.arange(rows * cols, dtype=np.int32), max(cols, 1))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(value)], names=["path", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, row int, col int, value double")


def write_product(cells: DataFrame, folder: str, *, packed: bool = False) -> None:
    """A gridded product (product, var, year, month, lat_idx, lon_idx, value) by product, variable and year; ``packed`` stores hundredths."""
    v = S.pack_hundredths(F.col("value")) if packed else F.col("value").cast("float")
    cells.withColumn("value", v).write.mode("overwrite").partitionBy("product", "var", "year").option("compression", "zstd").parquet(folder)


def read_product(spark: SparkSession, folder: str, *, packed: bool = False) -> DataFrame:
    cells = spark.read.parquet(folder)
    return cells.withColumn("value", S.unpack_hundredths(F.col("value"))) if packed else cells


def write_reconstruction(rows: DataFrame, folder: str, *, csv: bool = False) -> None:
    """Station reconstructions; as CSV with four decimals."""
    if csv:
        fixed = [F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
        rows.select(*fixed).write.mode("overwrite").option("header", True).csv(folder)
    else:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(folder)
