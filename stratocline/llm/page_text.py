"""Main text of HTML pages: structure first, then a host suffix array for what structure leaves open.

Blocks are told apart by their place: inside the page's article or main element
they are text; inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments they are not; all others are open.  Open blocks,
beside an article or on a page without one, are text but for boilerplate: the token
streams of all that stands outside the articles of a host's pages are concatenated, a
suffix array sorts their suffixes to the depth of ``RUN`` tokens, and substrings of that
length that many of the pages share are covered; covered tokens go and unique runs stay.
A part of an article that only its name or an ``aside`` calls a menu, sidebar, notice or
the like is in doubt: the arrays judge it as if open where the host has ``PAGES`` pages
or more, its name where there are fewer.  Names on paragraphs, headings and inline
elements of an article tell adverts only.  Pages that differ in marked boilerplate alone are
one page.  ``PAGES`` pages and ``SHARE`` percent of the
host's make a substring boilerplate, of blocks shorter than it ``SHORT_SHARE`` percent; a
covered run that is more than half of a page's text stays.

Scale: a host's pages are dealt into shards of bounded tokens.  Each shard builds its own
suffix array and sends one row per interval of equal prefixes with the number of
pages in it, and these rows are added up by host and prefix; so a host with
a third of all pages is never in one task.  Only open tokens are shuffled, not pages.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import cut, table
from stratocline.llm.hashing import mix64
from stratocline.llm.url_filter import host_of

RUN = 6  # tokens that a repeated substring has at least
PAGES, SHARE, SHORT_SHARE = 3, 5, 50
SHARD_TOKENS = 400_000
MANY = -1  # among covered places: the host has ``PAGES`` pages or more
BROADCAST_PAGES = 100_000  # pages whose covered places may be broadcast

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = frozenset(("script", "style", "textarea", "template", "iframe", "svg", "title", "xmp"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul".split())
_OUT = frozenset("head nav footer aside form button select menu dialog object canvas video audio annotation annotation-xml".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs footer contentinfo complementary comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login"
    " search searchform toolbar pagination pager widget skip".split()
)
#: Others' texts: an article among them is not the page's.
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
_OTHERS = _ADVERTS | frozenset("comment comments commentlist disqus reply replies respond related recommended".split())
#: Ids of readers' comments in an article, where an id mostly names a section.
_READERS = frozenset("comments commentlist disqus replies respond".split())
#: Elements that hold other parts of a page. In an article, names on any other element tell adverts only.
_HOLDERS = frozenset("div section ul ol dl table article aside header footer nav form details fieldset figure".split())
#: Parts of a class name beside which a word still names the whole: site-footer, related-posts.
_BESIDE = frozenset("site page top bottom global box list bar block wrapper container section area links form posts header".split())
_IN_WORDS = frozenset(("main", "article", "articlebody"))


def _names(value: str) -> set[str]:
    """Whole names of a class, id or role; of one in parts, the words if all parts are such words or may stand beside them."""
    out: set[str] = set()
    for name in value.split():
        parts = set(re.split(r"[^a-z0-9]+", name)) - {""}
        out.update(parts if parts <= _OUT_WORDS | _BESIDE else {name})
    return out


def _zone(parent: str, tag: str, attributes: str) -> str:
    """The zone of an element: in, open, out, loose for what is out but for an article or main in it, or doubt for what an article holds and the arrays judge."""
    if parent == "out" or tag in _OUT and tag != "form" and not (tag == "aside" and parent == "in"):
        return "out"
    if tag == "noscript":
        return parent if parent == "in" else "out"
    if tag in ("html", "body"):
        return parent
    words: set[str] = set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "out"
            if name in ("class", "role"):
                words |= _names(value)
            elif name == "id" and not re.fullmatch("h[1-6]", tag):
                # in an article an id names a section: only readers' comments are told by it
                words |= _names(value) & _READERS if parent == "in" else _names(value)
    if tag in ("article", "main"):
        return "out" if any({"comment", "comments"} & set(re.split(r"[^a-z0-9]+", w)) for w in words) else "in"
    if parent == "in" and tag not in _HOLDERS:
        words &= _ADVERTS
    if words & _OTHERS:
        return "out"
    if parent == "doubt" or parent == "in" and tag != "form" and (tag == "aside" or words & _OUT_WORDS):
        return "doubt"
    if parent == "loose" or tag == "form" or words & _OUT_WORDS or parent != "in" and (tag == "header" or "header" in words):
        return "loose"
    return "in" if words & _IN_WORDS else parent


def zoned(html: str | None) -> list[tuple[str, str]]:
    """(zone, block) in page order: in, open, doubt or marked; references decoded, white space collapsed."""
    html = html or ""
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    zone, at = "open", 0

    def flush() -> None:
        if text:
            block = " ".join(unescape("".join(text)).split()) if len(text) == 1 else " ".join("".join(map(unescape, text)).split())
            text.clear()
            if block:
                found.append((zone if zone in ("in", "open", "doubt") else "marked", block))

    while True:
        m = _TAG.search(html, at)
        if piece := html[at : m.start() if m else len(html)]:
            text.append(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    before = stack[i - 1][1] if i else "open"
                    if tag in _BLOCK or before != zone:
                        flush()
                    del stack[i:]
                    zone = before
                    break
            else:
                if tag in _BLOCK:
                    flush()
        elif tag in ("svg", "math") and m[3].endswith("/"):
            continue
        elif tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
        elif tag in _VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
        else:
            now = _zone(zone, tag, m[3])
            if tag in _BLOCK or now != zone:
                flush()
            if not m[3].endswith("/"):
                stack.append((tag, now))
                zone = now
    flush()
    return found


def blocks(html: str | None) -> tuple[list[str], list[str], list[str]]:
    """Blocks of the article, open blocks, and marked boilerplate with what is in doubt, each in page order."""
    found = zoned(html)
    return [b for z, b in found if z == "in"], [b for z, b in found if z == "open"], [b for z, b in found if z in ("doubt", "marked")]


def prefixes(tokens: list[str], run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the ``run`` tokens from each place, as signed integers."""
    n = len(tokens) - run + 1
    if n <= 0:
        return np.empty(0, np.int64)
    own = np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little") for t in tokens], np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = mix64(out * np.uint64(0xA0761D6478BD642F) + own[k : k + n])
    return out.view(np.int64)


def suffix_order(codes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a token stream to the depth of ``run`` tokens, and the rank of each suffix's prefix.

    Prefix doubling: ranks of 1, 2, 4 ... tokens, the last step overlapping so
    that exactly ``run`` tokens count.  Places beyond the end rank lowest.
    """
    rank, have = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1, 1
    while have < run:
        step = min(have, run - have)
        later = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    return np.argsort(rank, kind="stable"), rank


def _ordered(streams: list[list[str]], pages: list[int], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash and page of each prefix of ``run`` tokens in the order of the suffix array, and where an interval of equal ones begins."""
    words: dict[str, int] = {}
    codes, owner, hashes = [], [], []
    for page, tokens in zip(pages, streams):
        if len(tokens) < run:
            continue
        codes.append(np.array([*[words.setdefault(t, len(words)) for t in tokens], -1 - len(codes)], np.int64))
        full = len(tokens) - run + 1
        owner.append(np.concatenate([np.full(full, page, np.int64), np.zeros(run, np.int64)]))
        hashes.append(np.concatenate([prefixes(tokens, run), np.zeros(run, np.int64)]))
        codes[-1][-1] = -len(codes)  # an end of its own for each page
    if not codes:
        none = np.empty(0, np.int64)
        return none, none, none
    valid = np.concatenate([np.arange(len(c)) < len(c) - run for c in codes])
    order, rank = suffix_order(np.concatenate(codes), run)
    order = order[valid[order]]
    first = np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) != 0]))
    return np.concatenate(hashes)[order], np.concatenate(owner)[order], first


def intervals(streams: list[list[str]], pages: list[int], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct prefix of ``run`` tokens in the pages' streams: its hash, and the least and greatest page that holds it."""
    hashes, page, first = _ordered(streams, pages, run)
    if not len(first):
        return hashes, page, page
    return hashes[first], np.minimum.reduceat(page, first), np.maximum.reduceat(page, first)


def supports(streams: list[list[str]], pages: list[int], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct prefix of ``run`` tokens in the pages' streams: its hash, and how many pages hold it."""
    hashes, page, first = _ordered(streams, pages, run)
    if not len(first):
        return hashes, page
    group = np.repeat(np.arange(len(first)), np.diff([*first, len(page)]))
    order = np.lexsort((page, group))
    new = np.concatenate([[True], (np.diff(group[order]) != 0) | (np.diff(page[order]) != 0)])
    return hashes[first], np.add.reduceat(new.astype(np.int64), first)


def padded(block: str, run: int = RUN) -> list[str]:
    """The tokens of a block, a shorter one filled up, so that it can only repeat as a whole."""
    tokens = block.split(" ")
    return tokens + ["\n"] * (run - len(tokens))


def unique_runs(judged: list[str], covered: set[int], beside: int = 0, run: int = RUN) -> list[str]:
    """What is left of each judged block without the tokens of covered substrings, which begin at the given places of the stream.

    A substring lies in one block: what follows repeated boilerplate is never taken with it.
    A run of covered tokens, over blocks too, that is more than half of all stays; all are the judged
    tokens and ``beside`` others, those of the article.
    """
    split = [block.split(" ") for block in judged]
    gone = np.zeros(sum(map(len, split)), bool)
    at = 0
    for tokens in split:
        for p in range(len(tokens)):
            if at + p in covered:
                gone[at + p : at + min(p + run, len(tokens))] = True
        at += len(tokens)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for start, end in edges.reshape(-1, 2):
        if 2 * (end - start) > len(gone) + beside:
            gone[start:end] = False
    out, at = [], 0
    for tokens in split:
        out.append(" ".join(t for i, t in enumerate(tokens) if not gone[at + i]))
        at += len(tokens)
    return out


def main_text(html: str | None, covered: set[int]) -> str:
    """The text of a page: its article, and of its judged blocks what ``covered`` leaves, in page order.

    ``covered`` has the places where covered substrings begin in the stream of the judged blocks, and
    ``MANY`` where the host has enough pages for the arrays to judge what is in doubt.
    """
    found = zoned(html)
    judged = [b for z, b in found if z in ("open", "doubt")]
    left = iter(unique_runs(judged, covered, sum(b.count(" ") + 1 for z, b in found if z == "in")) if judged else ())
    out = []
    for zone, block in found:
        if zone == "in":
            out.append(block)
        elif zone in ("open", "doubt"):
            rest = next(left)
            if rest and (zone == "open" or MANY in covered):
                out.append(rest)
    return "\n".join(out)


def hosts(pages: DataFrame) -> DataFrame:
    """(s_host, shards, of): into how many shards a host's tokens go, and how many pages it has; pages: (host, page, stream)."""
    size = F.regexp_count("stream", F.lit("[ \n]")) + 1
    return pages.groupBy(F.col("host").alias("s_host")).agg(F.ceil(F.sum(size) / SHARD_TOKENS).alias("shards"), F.count_distinct("page").alias("of"))


def repeated_prefixes(pages: DataFrame, shards: DataFrame) -> DataFrame:
    """(host, prefix, most) of the substrings that enough of a host's pages share, and whether most do; pages: (host, page, stream)."""
    spec = pa.schema([("host", pa.string()), ("prefix", pa.int64()), ("support", pa.int64())])

    def build(group: pa.Table) -> pa.Table:
        pages_ = group.column("page").to_pylist()
        blocks_ = [(p, padded(b)) for p, s in zip(pages_, group.column("stream").to_pylist()) for b in s.split("\n")]
        prefix, support = supports([b for _, b in blocks_], [p for p, _ in blocks_])
        host = group.column("host")[0].as_py()
        return pa.Table.from_arrays([pa.array([host] * len(prefix), pa.string()), pa.array(prefix), pa.array(support)], schema=spec)

    dealt = pages.join(shards, F.col("host") == F.col("s_host")).withColumn("shard", F.pmod(F.xxhash64("page", F.lit(1)), F.col("shards"))).select("host", "shard", "page", "stream")
    found = dealt.groupBy("host", "shard").applyInArrow(build, "host string, prefix long, support long")
    # a page is in one shard, so that supports add up
    added = found.groupBy("host", "prefix").agg(F.sum("support").alias("support")).where(F.col("support") >= PAGES)
    held = added.join(shards.select("s_host", "of"), F.col("host") == F.col("s_host"))
    return held.where(100 * F.col("support") >= SHARE * F.col("of")).select("host", "prefix", (100 * F.col("support") >= SHORT_SHARE * F.col("of")).alias("most"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html).

    Null html is empty; a page without text gives an empty string; null urls and
    urls without a host share the empty host; ids may be null or repeated, a row each.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url"))).withColumn("page", F.xxhash64(F.coalesce("html", F.lit(""))))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, page, content, stream, bare = [], [], [], [], []
            for h, p, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = zoned(html.as_py())
                inside, open_ = [x for z, x in found if z == "in"], [x for z, x in found if z == "open"]
                judged, marked = [x for z, x in found if z in ("open", "doubt")], [x for z, x in found if z == "marked"]
                # what a page says besides its marked boilerplate
                own = int.from_bytes(hashlib.blake2b("\n".join([*inside, "", *open_]).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                for part, used in ((judged, True), (marked, False)):
                    if part:
                        host.append(h)
                        page.append(p)
                        content.append(own)
                        stream.append("\n".join(part))
                        bare.append(used)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(content, pa.int64()), pa.array(stream, pa.string()), pa.array(bare, pa.bool_())], names=["host", "page", "content", "stream", "bare"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(b.num_rows):
                parts = b.column(2)[s].as_py().split("\n")
                hashes = [prefixes(padded(x)) for x in parts]
                starts = np.cumsum([0, *[x.count(" ") + 1 for x in parts]])
                found = np.concatenate(hashes)
                place = np.concatenate([at + np.arange(len(h), dtype=np.int32) for at, h in zip(starts, hashes)]).astype(np.int32)
                short = np.concatenate([np.full(len(h), x.count(" ") + 1 < RUN) for x, h in zip(parts, hashes)])
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[s].as_py()] * len(found), pa.string()), pa.array([b.column(1)[s].as_py()] * len(found), pa.int64()), pa.array(found), pa.array(place), pa.array(short)], names=["host", "page", "prefix", "place", "short"])

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(html.as_py(), set(covered or ())) for html, covered in zip(b.column(2), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    streams = cut(pages.select("host", "page", "html").mapInArrow(opened, "host string, page long, content long, stream string, bare boolean").distinct())
    counted = streams.select("host", F.col("content").alias("page"), "stream").distinct()
    shards = cut(hosts(counted))
    repeated = repeated_prefixes(counted, shards)
    bare = streams.where("bare").select("host", "page", "stream")
    at = bare.mapInArrow(places, "host string, page long, prefix long, place int, short boolean")
    hit = at.join(repeated, ["host", "prefix"]).where(~F.col("short") | F.col("most")).select("host", "page", "place")
    many = bare.join(shards.where(F.col("of") >= PAGES), F.col("host") == F.col("s_host"), "left_semi").select("host", "page", F.lit(MANY).alias("place"))
    covered = cut(hit.unionByName(many).groupBy(F.col("host").alias("c_host"), F.col("page").alias("c_page")).agg(F.collect_list("place").alias("covered")))
    few = covered.count() <= BROADCAST_PAGES and (covered.agg(F.coalesce(F.sum(F.size("covered")), F.lit(0))).first()[0]) <= 20 * BROADCAST_PAGES
    joined = pages.join(F.broadcast(covered) if few else covered, (F.col("host") == F.col("c_host")) & (F.col("page") == F.col("c_page")), "left")
    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "covered").mapInArrow(text, f"page_id {kind}, url string, text string, n_chars long")


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
