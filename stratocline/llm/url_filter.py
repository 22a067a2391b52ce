"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

A rule is a glob over ``host + path``: ``*`` stands for anything, ``^`` for one
separator or the end, a leading ``||`` anchors the glob at the start of the host or
of one of its labels.  The literal tokens of a rule ([a-z0-9]+ runs with a known
boundary on both sides) all occur in every URL that it fits, so a rule needs to be
tried only on URLs holding its rarest token; token frequencies are counted over
all URLs.  Only those candidate pairs of URL and rule run a regular expression.

Scale: URLs are exploded into distinct tokens and equi-joined with the index; the
side of the rules is one row per rule, so Catalyst broadcasts it when its size in
bytes is below the session's threshold and shuffles otherwise.  The best candidate
per URL is a partial aggregate; no URL meets all rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import lower_ascii, table


class Rule(NamedTuple):
    """``name`` is reported; ``rank`` 1 beats 0, then the longer ``name`` wins, then block, then the name."""

    name: str
    glob: str
    verdict: str
    rank: int = 0


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains and a prefix of the path."""
    return Rule(host + path, f"||{host}{path}*", verdict, 1)


#: The host and path rules that the query applies.
HOST_RULES = (
    host_rule("com", "/", "allow"),
    host_rule("example.com", "/en/", "block"),
    host_rule("www.example.com", "/en/", "allow"),
    host_rule("net", "/es/", "block"),
    host_rule("net", "/fr/", "block"),
)

#: Patterns that speak where no host and path rule does; what no pattern fits is allowed.
PATTERN_RULES = (
    Rule("spam farm", "||spam-farm.*", "block"),
    Rule("cheap pills", "||cheap-pills.*", "block"),
    Rule("casino", "||casino.*", "block"),
    Rule("installer", "*/download/*.exe^", "block"),
)


def literal_tokens(glob: str) -> list[str]:
    """Tokens that each fitting URL holds as whole tokens: no ``*`` or open end beside them."""
    anchored = glob.startswith("||")
    body = glob.removeprefix("||")
    found = []
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and anchored
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.append(m[0].lower())
    return found


def to_regex(glob: str) -> str:
    """The Java regular expression of a glob, for the whole of ``host + path``."""
    parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
    body = "".join(parts.get(c) or re.sub(r"([^A-Za-z0-9])", r"\\\1", c) for c in glob.removeprefix("||"))
    return "(?s)^" + (r"(?:[^/]*\.)?" if glob.startswith("||") else "") + body + "$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: Iterable[Rule], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per distinct URL: (url, host, path, rule, rank, verdict); rule and rank are null where none fits.

    Null is a URL of its own without host and path; empty tables give an empty
    result; other columns are ignored.
    """
    spark = urls.sparkSession
    rules = list(rules)
    judged = urls.select(F.col(url_col).alias("url")).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # the empty token is held by all URLs; only rules without a literal token are filed there
    tokens = F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))
    if any(not literal_tokens(r.glob) for r in rules):
        tokens = F.array_union(tokens, F.array(F.lit("")))
    exploded = judged.select("url", "host", "path", F.explode(tokens).alias("token"))
    entries = [F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("rule_verdict"), F.lit(r.rank).alias("rank"), F.lit(to_regex(r.glob)).alias("pattern"), F.array(*map(F.lit, literal_tokens(r.glob) or [""])).alias("tokens")) for r in rules]
    listed = spark.range(1).select(F.inline(F.array(*entries)))
    filed = listed.select("name", "rule_verdict", "rank", "pattern", F.explode("tokens").alias("token"))
    wanted = filed.select("token").distinct()
    seen = exploded.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    index = (
        filed.join(seen, "token", "left")
        .groupBy("name", "rule_verdict", "rank", "pattern")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest"))
        .select("name", "rule_verdict", "rank", "pattern", F.col("rarest.token").alias("token"))
    )
    fits = exploded.join(index, "token").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    order = F.struct("rank", F.length("name").alias("long"), (F.col("rule_verdict") == "block").alias("blocks"), "name", "rule_verdict")
    best = fits.groupBy(F.col("url").alias("b_url")).agg(F.max(order).alias("best"))
    return judged.join(best, F.col("url").eqNullSafe(F.col("b_url")), "left").select(
        "url", "host", "path", F.col("best.name").alias("rule"), F.col("best.rank").alias("rank"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL by the host and path rules, else by the patterns; ``pattern`` names the pattern that spoke."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    told = judge(pages, (*HOST_RULES, *PATTERN_RULES)).withColumnRenamed("url", "j_url")
    return pages.join(told, F.col("url").eqNullSafe(F.col("j_url"))).select(
        "page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict", F.when(F.col("rank") == 0, F.col("rule")).alias("pattern")
    )


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT p.*, r.h || r.q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.h OR suffix(p.host, '.' || r.h)) AND starts_with(p.path, r.q)),
b AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(host || path, '(?s)^(?:[^/]*\.)?cheap-pills\.') THEN 'cheap pills'
    WHEN regexp_matches(host || path, '(?s)^.*/download/.*\.exe(?:[^A-Za-z0-9_.%-]|$)$') THEN 'installer'
    WHEN regexp_matches(host || path, '(?s)^(?:[^/]*\.)?spam-farm\.') THEN 'spam farm'
    WHEN regexp_matches(host || path, '(?s)^(?:[^/]*\.)?casino\.') THEN 'casino' END AS pattern
  FROM m WHERE k = 1)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM b
"""
