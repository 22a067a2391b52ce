"""Per-station CSV files as a data source that leaves a file after its first record where the station is out of the box."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from stratocline.functions.scalars import tenths_per_month_to_daily

COLUMNS = {"id": pa.string(), "name": pa.string(), "lat": pa.float64(), "lon": pa.float64(), "elev": pa.float64(), "yyyymm": pa.int32(), "raw": pa.float64(), "mflag": pa.string(), "qflag": pa.string(), "sflag": pa.string(), "src": pa.string()}
SCHEMA = "id string, name string, lat double, lon double, elev double, yyyymm int, raw double, mflag string, qflag string, sflag string, src string"
#: Bytes of files that one task reads, bytes of a block, bytes in which a first record ends.
TASK_BYTES, BLOCK_BYTES, FIRST_BYTES = 64 << 20, 1 << 20, 4096
_BOUNDED = ("lat", "lon", "yyyymm")


@dataclass
class Files(D.InputPartition):
    paths: list[str]


class StationReader(D.DataSourceReader):
    """Bounds of lat, lon and yyyymm come from options: ``lat_min`` and so on."""

    def __init__(self, options: dict[str, str]):
        self.path = re.sub(r"^file:/+", "/", options["path"])
        self.bounds = {c: [float(options.get(f"{c}_min", "-inf")), float(options.get(f"{c}_max", "inf"))] for c in _BOUNDED}

    def _system(self) -> tuple[pafs.FileSystem, str]:
        return (pafs.LocalFileSystem(), self.path) if self.path.startswith("/") else pafs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[D.InputPartition]:
        """Files by their size; the driver lists them and opens none."""
        system, root = self._system()
        files = [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".csv")]
        parts, size = [Files([])], 0
        for f in sorted(files, key=lambda f: f.path):
            if parts[-1].paths and size + f.size > TASK_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        lay = {"read_options": pacsv.ReadOptions(column_names=list(COLUMNS), block_size=BLOCK_BYTES), "convert_options": pacsv.ConvertOptions(column_types=COLUMNS, strings_can_be_null=True)}
        for path in partition.paths:
            with system.open_input_file(path) as f:
                head = f.read(FIRST_BYTES)
            first = head.split(b"\n", 1)[0].strip()
            if not first or b"\n" in head and not self._inside(pacsv.read_csv(pa.BufferReader(first + b"\n"), **lay), ("lat", "lon")).num_rows:
                continue
            with system.open_input_stream(path) as stream, pacsv.open_csv(stream, **lay) as rows:
                for batch in rows:
                    kept = self._inside(pa.Table.from_batches([batch]), _BOUNDED)
                    if kept.num_rows:
                        yield from kept.to_batches()

    def _inside(self, rows: pa.Table, names: Iterable[str]) -> pa.Table:
        for name in names:
            lo, hi = self.bounds[name]
            if (lo, hi) != (float("-inf"), float("inf")):
                v = pc.cast(rows[name], pa.float64())
                rows = rows.filter(pc.and_(pc.greater_equal(v, lo), pc.less_equal(v, hi)))
        return rows


class FilteredReader(StationReader):
    """The same with the bounds in pushed filters; the session must allow ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.bounds and isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual, D.EqualTo)):
                self.bounds[name][0] = max(self.bounds[name][0], float(f.value))
            if name in self.bounds and isinstance(f, (D.LessThan, D.LessThanOrEqual, D.EqualTo)):
                self.bounds[name][1] = min(self.bounds[name][1], float(f.value))
            yield f  # Spark tests each row again


class StationArchive(D.DataSource):
    """``station_csv``: a folder of files without header, one station each; its first record tells the station's place.

    With the option ``pushdown``, filters bound what is read, beside the options.
    """

    @classmethod
    def name(cls) -> str:
        return "station_csv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StationReader:
        pushed = str(self.options.get("pushdown", "false")).lower() == "true"
        return (FilteredReader if pushed else StationReader)(dict(self.options))


def load_archive(spark: SparkSession, folder: str, lat: tuple[float, float], lon: tuple[float, float], first: int, last: int) -> DataFrame:
    """(id, year, month, lat, lon, elev, value) in mm a day of the stations in the box, years first to last.

    Files of other stations are read up to their first record only, in the tasks.  A file that cannot be read as numbers ends the query.
    """
    spark.dataSource.register(StationArchive)
    bounds = {"lat": lat, "lon": lon, "yyyymm": (first * 100 + 1, last * 100 + 12)}
    reader = spark.read.format("station_csv").options(**{f"{c}_{end}": str(v) for c, b in bounds.items() for end, v in zip(("min", "max"), b)})
    year, month = F.floor(F.col("yyyymm") / 100).cast("int"), F.pmod("yyyymm", F.lit(100)).cast("int")
    rows = reader.load(folder).where(F.col("id").isNotNull() & month.between(1, 12)).select("id", year.alias("year"), month.alias("month"), "lat", "lon", "elev", "raw")
    return rows.withColumn("value", tenths_per_month_to_daily(F.col("raw"), F.col("year"), F.col("month"))).drop("raw")


def write_archive(rows: DataFrame, folder: str) -> None:
    """Rows (id, name, lat, lon, elev, yyyymm, raw, mflag, qflag, sflag, src) as one file a station, months in order."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.select(*COLUMNS, F.col("id").alias("station")).repartition(tasks, "station").sortWithinPartitions("station", "yyyymm").write.mode("overwrite").partitionBy("station").csv(folder)
