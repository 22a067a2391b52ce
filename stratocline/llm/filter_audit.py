"""Audit of how corpus filters interact: what each filter removes at each place of every order.

Five filters, each a failure flag of a document:

A  fewer than 50 words;  B  fewer than 65 distinct words in 100;  C  more than 5 of ``[A-Z]`` in 100
code points;  D  any of ``#$%&*|``;  E  the text of a smaller ``doc_id`` once more, whatever became of that one.

Counts of documents by part, flags and label go through SQL's ``CUBE`` over the five flags and the part.
The grouping set of some flags has, where all of them are false, the documents that these filters
leave, in any order.  So each step of each order is a pair of such subsets, before and after the step; a join of
the pairs with the subsets' survivors gives every count, and the weights of the pairs give the Shapley values.

Scale: texts are read once and never shuffled.  Rows of (digest, part, label, id) are counted before the shuffle
and again without the id, so that a text or a part with a third of all rows arrives as few rows from each task.
The flags A to D are the text's own, so E needs no row again: of a digest's rows only the count at the smallest
id is kept.  The cube sees at most 128 rows a part, from a written
table, so that the texts are scanned once; steps (600) and subsets (32) are fixed tables.

Edges: a null text is the empty text, which fails A only (and E where a smaller id has it too). A null
``doc_id`` is neither smaller than another nor greater, so it never fails E. Rows that share the smallest id of a text
pass E together.  A null part is the empty string.  Labels that repeat an id count once, as 1 if any row says so;
labels without an id belong to no document. No documents give no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import WORD, cut, table

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The flags of a whole text that depend on it alone, by the names of ``words`` and ``distinct`` for its word counts."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.col("words") < 50,
        "B": 100 * F.col("distinct") < 65 * F.col("words"),
        "C": 100 * capitals > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): counts of documents, at most 32 rows a part."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = rows.withColumn("w", words).withColumn("words", F.size("w")).withColumn("distinct", F.size(F.array_distinct("w")))
    flags = failures(F.col("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in flags.items()))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marks, F.col("doc_id") == F.col("l_id"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "part", "good", "toxic", *flags]
    by_id = rows.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # of the smallest id the number of its rows comes along
    groups = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    lowest = groups.groupBy(F.col("digest").alias("low_digest")).agg(F.min("first.doc_id").alias("lowest"))
    groups = groups.join(lowest, F.col("digest") == F.col("low_digest"))
    passed = F.coalesce("nameless", F.lit(0)) + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("E"), passed.alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - passed).alias("m")))
    split = groups.select("part", "good", "toxic", *flags, F.inline(both)).where("m > 0")
    sums = [F.sum("m").alias("n"), *(F.sum(F.when(F.col(c), F.col("m")).otherwise(0)).alias(c) for c in ("good", "toxic"))]
    return split.groupBy("part", *FILTERS).agg(*sums)


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): what the filters of each subset, bit i for the i-th letter, leave of each part.

    Subsets that leave nothing have rows of zeros.
    """
    cube = counts.cube("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS), *(F.grouping(c).alias(f"g_{c}") for c in ("part", *FILTERS)))
    clear = cube.where(F.col("g_part") == 0)
    subset = F.lit(0)
    for i, c in enumerate(FILTERS):
        clear = clear.where((F.col(f"g_{c}") == 1) | ~F.col(c))
        subset = subset + F.when(F.col(f"g_{c}") == 0, 1 << i).otherwise(0)
    left = clear.select(F.col("part").alias("s_part"), subset.alias("s_subset"), *COUNTS)
    every = counts.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    filled = every.join(left, (F.col("part") == F.col("s_part")) & (F.col("subset") == F.col("s_subset")), "left")
    return filled.select("part", "subset", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, after, bit): the 600 steps of all orders, as pairs of subsets."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, i in enumerate(order, 1):
            rows.append(("".join(FILTERS[j] for j in order), k, before, before | 1 << i, 1 << i))
            before |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, before int, after int, bit int")


def pairs(spark: SparkSession) -> DataFrame:
    """(p_before, p_after, p_bit, orders): the 80 pairs of subsets that differ by one filter, with the number of orders that pass through each."""
    count, rows = len(FILTERS), []
    for subset in range(1 << count):
        size = subset.bit_count()
        rows += [(subset, subset | 1 << i, 1 << i, factorial(size) * factorial(count - 1 - size)) for i in range(count) if not subset >> i & 1]
    return spark.createDataFrame(rows, "p_before int, p_after int, p_bit int, orders long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order and step; see the module for the counts and edges."""
    spark = docs.sparkSession
    left = cut(survivors(cut(judged(docs, labels, part))))
    side = lambda x: left.select(F.col("part").alias(f"part_{x}"), F.col("subset").alias(f"subset_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in COUNTS))
    # what a pair of subsets differs by, for each part; every step is one of these pairs
    pair = F.broadcast(pairs(spark)).join(side("p"), F.col("p_before") == F.col("subset_p")).join(side("q"), (F.col("p_after") == F.col("subset_q")) & (F.col("part_p") == F.col("part_q")))
    pair = pair.select(F.col("part_p").alias("part"), "p_before", "p_after", "p_bit", "orders", F.col("n_q").alias("kept"), *((F.col(f"{c}_p") - F.col(f"{c}_q")).alias(f"{c}_out") for c in COUNTS))
    all_ = (1 << len(FILTERS)) - 1
    only = lambda before: F.max(F.when(F.col("p_before") == before, F.col("n_out")))
    whole = pair.groupBy(F.col("part").alias("w_part"), F.col("p_bit").alias("w_bit")).agg(
        only(0).alias("fails"), only(F.lit(all_) - F.col("p_bit")).alias("unique_fails"), F.sum(F.col("n_out") * F.col("orders")).alias("shapley"))
    pair = pair.join(whole, (F.col("part") == F.col("w_part")) & (F.col("p_bit") == F.col("w_bit")))
    made = pair.join(F.broadcast(steps(spark)), (F.col("p_before") == F.col("before")) & (F.col("p_after") == F.col("after")))
    return made.select(
        "part", "filter_order", "step", "kept", F.col("n_out").alias("removed"), (F.col("fails") - F.col("n_out")).alias("redundant"),
        "unique_fails", F.col("good_out").alias("good_lost"), F.col("toxic_out").alias("toxic_lost"), "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e FROM w),
g AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
x AS MATERIALIZED (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM f LEFT JOIN g USING (doc_id)),
o(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE length(filter_order) < 5 AND NOT contains(filter_order, l)),
s AS MATERIALIZED (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS l FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE length(filter_order) = 5),
r AS (
  SELECT part, filter_order, step, l, good, toxic, contains(failed, l) AS fails, failed = l AS alone,
    length(translate(substr(filter_order, 1, step - 1), failed, '')) < step - 1 AS gone FROM x, s),
n AS (
  SELECT part, filter_order, step, l, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
    count(*) FILTER (alone) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, l)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM n
"""
