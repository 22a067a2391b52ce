"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits.  A mask is laid over
every position; the tokens under its ones are hashed, those under its zeros may
differ.  Training and benchmark hashes are joined; each hit fixes how the item
would lie on the document, and around it the aligned tokens are compared: an
overlap counts where a window of ``WINDOW`` aligned tokens (the whole item where that
is shorter) agrees in ``PERCENT`` percent of its places or more.  Each length of item has
masks of which at least one hits wherever its window may differ in the places allowed,
so no overlap is lost to the seeds, however short the item.

Scale: the hashes of documents are never stored.  The benchmark's are counted, and
broadcast only up to ``BROADCAST_SEEDS`` rows; a larger benchmark
is joined by a shuffle on the hash.  Hits are reduced to one row per document, item
and alignment before the shuffle, of items of ``EXACT`` tokens or fewer, however frequent,
to one per document and item; tokens are compared only for those documents.  The tokens of items
join the alignments, and a document's tokens are sent once, whatever the number of its alignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import cut, table, text_key as key_of

#: By the least number of tokens of an item: masks that together hit every placing of the mismatches that a window allows.
#: Ones are compared, zeros ignored.
LOSSLESS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",),
    5: ("1111", "11101", "11011", "10111"), 8: ("111011", "110111"),
    10: ("111011", "1101011", "1110011"), 15: ("11111", "110101001"),
}
WINDOW, PERCENT = 15, 80
EXACT = 4  # items of so many tokens must be there as they are: all their alignments in a document are alike
BROADCAST_SEEDS = 1_000_000  # rows of the benchmark's seeds (some 80 bytes each in a hash table)
BROADCAST_HITS = 300_000  # alignments (about 40 bytes each) whose documents are found by a broadcast


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _least(words: Column) -> Column:
    """The key of ``LOSSLESS`` for an item; null for one without tokens."""
    return F.array_max(F.filter(F.array(*[F.lit(k) for k in LOSSLESS]), lambda k: k <= F.size(words)))


def _seeds(words: Column, hashes: Column, least: int) -> Column:
    """An array of (pos, seed): the hash of each mask for items of ``least`` tokens or more at each position where it fits."""

    def under(number: int, mask: str):
        ones = [i for i, c in enumerate(mask) if c == "1"]
        return lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(100 * least + number), *[F.get(hashes, i + o) for o in ones]).alias("seed"))

    made = []
    for number, mask in enumerate(LOSSLESS[least]):
        last = F.size(words) - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        made.append(F.transform(places, under(number, mask)))
    return F.concat(*made)


def _hashed(rows: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    words = rows.select(*keys, tokens(F.col(text_col)).alias("__words"))
    return words.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))


def seeds(rows: DataFrame, text_col: str, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys..., pos, seed) of all rows, for items of the given keys of ``LOSSLESS``."""
    if not lengths:
        return rows.select(*keys, F.lit(0).alias("pos"), F.lit(0).cast("long").alias("seed")).limit(0)
    made = F.concat(*[_seeds(F.col("__words"), F.col("__hashes"), k) for k in lengths])
    return _hashed(rows, text_col, keys).select(*keys, F.inline(made))


def item_seeds(items: DataFrame, text_col: str, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys..., pos, seed) of items, each under the masks of its own length."""
    if not lengths:
        return seeds(items, text_col, keys, lengths)
    none = F.array().cast("array<struct<pos:int,seed:bigint>>")
    made = F.concat(*[F.when(_least(F.col("__words")) == k, _seeds(F.col("__words"), F.col("__hashes"), k)).otherwise(none) for k in lengths])
    return _hashed(items, text_col, keys).select(*keys, F.inline(made))


def _window_matches(same: Column, width: Column) -> Column:
    """The most matches in any ``width`` places in a row of an array of zeros and ones."""
    at = F.sequence(F.lit(1), F.size(same) - width + 1)
    return F.array_max(F.transform(at, lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda a, x: a + x)))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_token, aligned, matched, window_matched), a row per document and item that overlap.

    ``doc_token`` is where the first compared token stands in the document, ``aligned``
    how many tokens were compared and ``matched`` how many of them agree, of the best
    alignment.  Items without tokens match nothing; items of 4 tokens or fewer must be there as they are.
    Null texts and items have no tokens; rows of one id count as one document; null
    ids are reported as null.  Other columns are ignored.
    """
    best = _found(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "item_id", "x.doc_token", "x.aligned", "x.matched", "x.window_matched")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, x) of each alignment that counts."""
    docs = docs.select("doc_id", "text").withColumn("text_key", key_of(F.col("text")))
    items = benchmark.select("item_id", F.col("text").alias("item_text")).distinct()
    lengths = sorted(r[0] for r in items.select(_least(tokens(F.col("item_text"))).alias("k")).where("k IS NOT NULL").distinct().collect())
    listed = cut(item_seeds(items, "item_text", ["item_id", "item_text"], lengths).select("item_id", F.xxhash64("item_text").alias("item_key"), F.col("pos").alias("item_pos"), "seed", (F.size(tokens(F.col("item_text"))) <= EXACT).alias("exact")))
    known = F.broadcast(listed) if listed.count() <= BROADCAST_SEEDS else listed
    hits = seeds(docs, "text", ["doc_id", "text_key"], lengths).join(known, "seed")
    shift = F.col("pos") - F.col("item_pos")
    # the last of alignments that are alike stands for all, as it does in the result
    lay = hits.groupBy("doc_id", "text_key", "item_id", "item_key", F.when(~F.col("exact"), shift).alias("each")).agg(F.max(shift).alias("shift"))
    lay = cut(lay.drop("each"))
    few = lay.count() <= BROADCAST_HITS
    held = lay.select(*[F.col(c).alias(f"l_{c}") for c in lay.columns])
    # documents with a hit are tokenized once, and each alignment is compared once: both are written
    wanted = held.select("l_doc_id", "l_text_key").distinct()
    hit = docs.join(F.broadcast(wanted) if few else wanted, (F.col("text_key") == F.col("l_text_key")) & F.col("doc_id").eqNullSafe(F.col("l_doc_id")), "left_semi")
    hit = cut(hit.select("doc_id", "text_key", tokens(F.col("text")).alias("doc")))
    words = items.select(F.col("item_id").alias("i_id"), F.xxhash64("item_text").alias("i_key"), tokens(F.col("item_text")).alias("item"))
    laid = held.join(words, F.col("l_item_id").eqNullSafe(F.col("i_id")) & (F.col("l_item_key") == F.col("i_key")))
    laid = laid.select("l_doc_id", "l_text_key", F.col("l_item_id").alias("item_id"), F.col("l_shift").alias("shift"), "item")
    full = hit.join(laid, (F.col("text_key") == F.col("l_text_key")) & F.col("doc_id").eqNullSafe(F.col("l_doc_id")))
    begin = F.greatest(F.lit(0), -F.col("shift"))
    end = F.least(F.size("item"), F.size("doc") - F.col("shift"))
    full = full.withColumn("begin", begin).withColumn("aligned", end - begin)
    same = F.zip_with(F.slice("item", F.col("begin") + 1, F.col("aligned")), F.slice("doc", F.col("begin") + F.col("shift") + 1, F.col("aligned")), lambda a, b: (a == b).cast("int"))
    width = F.least(F.lit(WINDOW), F.size("item"))
    full = full.where(F.col("aligned") >= width).select("doc_id", "text_key", "item_id", "shift", "begin", "aligned", width.alias("width"), same.alias("same"))
    full = cut(full).withColumn("window_matched", _window_matches(F.col("same"), F.col("width")))
    good = full.where(100 * F.col("window_matched") >= PERCENT * F.col("width"))
    return good.select("doc_id", "text_key", "item_id", F.struct(F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("matched"), "window_matched", "aligned", (F.col("begin") + F.col("shift")).alias("doc_token")).alias("x"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap any item; rows of one id are one document, those without an id one each."""

    def own(doc_id: Column, key: Column) -> Column:
        return F.when(doc_id.isNull(), key).otherwise(F.lit(0))

    found = _found(docs, benchmark).select(F.col("doc_id").alias("o_id"), own(F.col("doc_id"), F.col("text_key")).alias("o_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["o_id"]) & (own(docs["doc_id"], key_of(docs["text"])) == found["o_key"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Without seeds: an overlap has PERCENT percent of a window's tokens in common at one shift, so equal tokens counted by shift find all.
OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM d),
bt AS (SELECT item_id, least({WINDOW}, len(w)) AS width, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM b),
l AS (SELECT doc_id, item_id, dt.i - bt.i AS shift FROM dt JOIN bt USING (t) GROUP BY ALL HAVING 100 * count(*) >= {PERCENT} * max(width)),
p AS (SELECT l.doc_id, l.item_id, l.shift, greatest(0, -l.shift) AS lo, least(len(b.w), len(d.w) - l.shift) AS hi, d.w AS dw, b.w AS bw, least({WINDOW}, len(b.w)) AS width
  FROM l JOIN d USING (doc_id) JOIN b USING (item_id)),
s AS (SELECT *, list_transform(range(lo, hi), lambda j: CAST(bw[j + 1] = dw[j + shift + 1] AS INT)) AS same FROM p WHERE hi - lo >= width),
x AS (SELECT *, list_max(list_transform(range(1, len(same) - width + 2), lambda i: list_sum(same[i:i + width - 1]))) AS wm FROM s),
r AS (SELECT doc_id, item_id, CAST(lo + shift AS INT) AS doc_token, CAST(hi - lo AS INT) AS aligned, CAST(list_sum(same) AS INT) AS matched, CAST(wm AS INT) AS window_matched
  FROM x WHERE 100 * wm >= {PERCENT} * width)
SELECT doc_id, item_id, doc_token, aligned, matched, window_matched
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, window_matched DESC, aligned DESC, doc_token DESC) AS k FROM r) WHERE k = 1
"""
