"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's
target divided by its source's size.  The documents of a source stand in the
order of (size, doc_id); the running sum of expected copies, shifted by one
offset per source, crosses integers, and each crossing emits one copy.  As
neighbours in that order have similar sizes, the words taken differ from the
target by at most about twice the largest document.

Scale: one source may hold any share of the rows.  The running sum is never a
window over a source: rows are range-partitioned by (source, size, doc_id), each
partition is numbered on its own, and the rows before it in its source are
added from a table with one row per partition and source.  The table of sources
goes through windows in one task, some 50 bytes a source: millions of sources are
its bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratocline.llm.common import cut, spare, table, text_key, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_docs, source_size, target) of rows with ``source`` and ``size``.

    Water-filling: sources sorted by size / weight; those below the level stop at
    ``max_repeats`` times their size and the rest share what is left by weight.
    One row per source goes through the global window, after a partial sum.
    """
    one = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    one = one.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    level = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * max_repeats
    one = (
        one.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # a source is capped if the level among those not smaller than it would lift it over its cap
    capped = F.col("left") * F.col("weight") > cap * F.col("heavy")
    one = one.withColumn("capped", capped)
    free = one.groupBy().agg(F.max(F.when(~F.col("capped"), F.struct(F.col("heavy"), F.col("left")))).alias("x")).select(F.col("x.left").alias("free_left"), F.col("x.heavy").alias("free_heavy"))
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("free_left") * F.col("weight") / F.col("free_heavy").cast("double"))
    return one.join(F.broadcast(free)).select("source", "source_docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def offset_of(source: Column, seed: int = SEED) -> Column:
    """One offset in [0, 1) for each source, the same in every run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _counted(sized: DataFrame, weights: Sequence[int], max_repeats: int, seed: int) -> DataFrame:
    """Rows of (doc_id, source, size, tie, ...) with ``source_size``, ``target`` and ``copies``."""
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("tie"))
    # the written table fixes which partition and place a row is in, whatever is lost or run again
    ranged = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    targets = source_targets(ranged, weights, max_repeats)
    # a source's rows are together in a partition: their numbers follow from the first one's place
    counts = ranged.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s_source"), F.col("part").alias("s_part"), "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    at = starts.join(targets, F.col("s_source").eqNullSafe(F.col("source"))).drop("source")
    rows = ranged.join(at, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("part") == F.col("s_part")))
    rate = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    u = offset_of(F.col("source"), seed)
    rank = (F.col("start") + F.col("place") - F.col("first") + 1).cast("double")
    copies = F.coalesce(F.floor(u + rank * rate) - F.floor(u + (rank - F.lit(1.0)) * rate), F.lit(0)).cast("long")
    return rows.withColumn("copies", copies)


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each row of ``docs``.

    Null texts have size 0; a null source is a source of its own, last in order;
    rows with a null id are kept and come first in their size; repeated rows are
    documents of their own; an empty table gives an empty result.  Sources of
    size 0 have target 0 and take nothing.  Other columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.lit(0).alias("tie"))
    rows = _counted(sized, weights, max_repeats, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, numbered by ``copy_no`` from 1.

    Rows are told apart as in ``mix``, those of one id, source and size by their texts.  Where ``docs``
    has a column ``copy_no``, it is kept and the number's name gets underscores.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text_key(F.col(text_col)).alias("tie"), row)
    taken = _counted(sized, weights, max_repeats, seed).where("copies > 0")
    number = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(spare(docs, "copy_no"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], number)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (
  SELECT source, count(*) AS source_docs, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight FROM s0),
s2 AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS left_size,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS heavy
  FROM s1 WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (
  SELECT *, left_size * weight > 3 * source_size * heavy AS capped FROM s2),
f AS (
  SELECT left_size AS fl, heavy AS fh FROM s3 WHERE NOT capped ORDER BY heavy DESC, left_size DESC LIMIT 1),
t AS (
  SELECT source, source_size, coalesce(CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(fl * weight AS DOUBLE) / CAST(fh AS DOUBLE) END, 0.0) AS target,
    CAST(CAST('0x' || substr(md5('20:' || coalesce(source, chr(0) || 'null')), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM s3 LEFT JOIN f ON TRUE),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, t.target / nullif(CAST(t.source_size AS DOUBLE), 0) AS rate,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS DOUBLE) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(coalesce(floor(u + k * rate) - floor(u + (k - 1.0) * rate), 0) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM c
"""
