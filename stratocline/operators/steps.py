"""Steps whose result is written, so that later ones neither repeat it nor carry its plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # folders of local sessions that name none


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session may do without and gets a temporary one, a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "")
        if not folder:
            folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="steps-")
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder; a lost executor costs no step before it."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
