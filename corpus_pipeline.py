"""The corpus pipeline: five stages over the documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept.  All but the last return the columns of ``documents``; the last returns them
with ``copy_no``, a row per copy that the mix takes.

An empty table stays empty in each stage; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm import byte_cnn, decontaminate, line_dedup, mixing, setsketch
from stratocline.llm.common import shared_dir, spare, table, text_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not reject; it is fitted on the labelled rows of ``documents``.

    Each row is judged by its whole text, repeated rows alike; null and empty texts have a score too.
    """
    model = byte_cnn.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = spare(docs, "score")
    return byte_cnn.score(docs, model, name).where(F.col(name) >= byte_cnn.THRESHOLD).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those without any line left go."""
    return line_dedup.without_lines(docs, line_dedup.dropped_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id. Each row is judged by its own text, whatever its id."""
    gone = setsketch.judged(docs).where(~F.col("kept")).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["g_id"]) & (text_key(docs["text"]) == gone["g_key"]), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null, empty and short texts hold none. Rows of one id go together, those without an id one by one."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; null texts have size 0, a null source is one of its own, repeated rows are documents of their own."""
    return mixing.emit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
]

#: The network, MinHash and SetSketch are beyond SQL; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
