"""Fitted models as Parquet tables: components, station models, spatial and serial models."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_models(models: DataFrame, folder: str) -> None:
    """Any table of models; a folder per month where it has one, so that a month is read alone."""
    writer = models.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("month") if "month" in models.columns else writer).parquet(folder)


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


@dataclass(frozen=True)
class ModelStore:
    """Versions of a table of models in a shared folder, bucketed and sorted by ``keys``: joins on these do not shuffle the models.

    ``name`` is the table's name in the session's catalog.  A version is replaced alone.  A manifest states its rows, buckets and inputs;
    it is written after the models, so that a version whose writing failed cannot be read.
    """

    spark: SparkSession
    name: str
    folder: str
    keys: tuple[str, ...] = ("month", "id")
    buckets: int = 64

    @property
    def _models(self) -> str:
        return f"{self.folder}/models"

    @property
    def _manifest(self) -> str:
        return f"{self.folder}/manifest"

    def save(self, models: DataFrame, version: str, inputs: Mapping[str, str]) -> None:
        """``inputs`` names what the models were fitted on; a store keeps the columns of its first version."""
        if not re.fullmatch(r"[\w.-]+", version):
            raise ValueError("a version is made of letters, digits, _, . and -")
        spread = models.withColumn("version", F.lit(version)).repartition(self.buckets, *self.keys)  # one file a bucket
        if self._open():
            known = self.spark.table(self.name)
            missing = set(known.columns) ^ set(spread.columns)
            if missing:
                raise ValueError(f"columns differ from those of the store: {sorted(missing)}")
            fitted = spread.select(*[c for c in known.columns if c != "version"])
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (version = '{version}') SELECT * FROM {{fitted}}", fitted=fitted)
        else:
            writer = spread.write.format("parquet").option("path", self._models).option("compression", "zstd")
            writer.partitionBy("version").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).mode("overwrite").saveAsTable(self.name)
        rows = self.spark.table(self.name).where(F.col("version") == version).count()
        entry = self.spark.range(1).select(F.lit(rows).cast("long").alias("rows"), F.lit(self.buckets).alias("buckets"), F.lit(",".join(self.keys)).alias("keys"), F.lit(json.dumps(dict(inputs), sort_keys=True)).alias("inputs"), F.lit(version).alias("version"))
        entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(self._manifest)

    def read(self, version: str) -> DataFrame:
        """The models of a version, without its column."""
        if not self._open() or not self.manifest().where(F.col("version") == version).count():
            raise ValueError(f"no version {version} in {self.folder}")
        return self.spark.table(self.name).where(F.col("version") == version).drop("version")

    def manifest(self) -> DataFrame:
        """(rows, buckets, keys, inputs, version)"""
        return self.spark.read.schema("rows long, buckets int, keys string, inputs string, version string").parquet(self._manifest)

    def _open(self) -> bool:
        """Whether the store has a version; a session that does not know the table learns it from the folder."""
        if not _exists(self.spark, self._manifest):
            return False
        if not self.spark.catalog.tableExists(self.name):
            laid = self.manifest().select("buckets", "keys").first()
            keys = ", ".join(f"`{k}`" for k in laid["keys"].split(","))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self._models).schema if f.name != "version")
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}, version STRING) USING parquet PARTITIONED BY (version) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {laid['buckets']} BUCKETS LOCATION '{self._models}'")
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        return True
