"""WARC packages, media columns, page text, URL filters: round trips, contracts, edges."""

import hashlib
import zipfile
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocline.llm import media, page_text, url_filter, warc_zip

PAGES = "page_id long, url string, html string, host string, key string, first long"


@pytest.fixture(scope="module")
def odd_pages(spark):
    long = "<p>" + "word " * 50_000 + "</p>"
    rows = [(1, "http://A.com/x", "<p>same</p>"), (2, "http://b.com/", "<p>same</p>"), (2, "http://b.com/", "<p>same</p>"), (3, None, None), (4, "no scheme", ""), (None, "x://h", "<p>same</p>"), (5, "a://b\r\nc/d", long), (6, "a://b", "<p>only</p>"), (None, "x://h", "alone")]
    return spark.createDataFrame([(*r, "h", "k", 1) for r in rows], PAGES)


# --- WARC ---


@pytest.mark.parametrize("zip64", [True, False])
def test_packages_are_zip_files(zip64):
    members = [("a/b", b"hello"), ("empty", b""), ("c", bytes(range(256)) * 9)]
    body = warc_zip.zip_stored(members, zip64=zip64)
    with zipfile.ZipFile(BytesIO(body)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members

    class File(BytesIO):
        def size(self):
            return len(self.getbuffer())

    found = warc_zip.zip_members(File(b"" + body))
    assert [(m.name, body[m.start : m.start + m.size], m.crc) for m in found] == [(n, d, zlib.crc32(d)) for n, d in members]
    with pytest.raises(ValueError):
        warc_zip.zip_members(File(b"nothing"))


def test_packages_of_other_writers_are_read():
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"content")
        z.comment = b"a comment"

    class File(BytesIO):
        def size(self):
            return len(self.getbuffer())

    m = warc_zip.zip_members(File(out.getvalue()))[0]
    assert out.getvalue()[m.start : m.start + m.size] == b"content"


def test_records_come_back(spark, odd_pages, tmp_path, monkeypatch):
    packages = warc_zip.write_packages(odd_pages, f"file://{tmp_path}/w")
    assert packages.agg(F.sum("records")).first()[0] == odd_pages.count()
    records = warc_zip.read_packages(packages).collect()
    want = [(r.page_id, (r.html or "").encode()) for r in odd_pages.collect()]
    full = {(r.page_id, bytes(r.payload)) for r in records if r.record_type == "response"}
    assert full == {w for w in want if (w[1] != b"<p>same</p>" or w[0] == 1) and w[0] != 4}
    assert {r.refers_to for r in records if r.record_type == "revisit" and r.digest == warc_zip.payload_digest(b"<p>same</p>")} == {1}
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in warc_zip.resolve_revisits(warc_zip.read_packages(packages)).collect())
    assert got == sorted((i or 0, len(p), warc_zip.payload_digest(p)) for i, p in want)


def test_text_ids_come_back(spark, tmp_path):
    rows = [("b", "http://a.com/", "<p>x</p>"), ("a", "http://b.com/", "<p>x</p>"), ("c", None, None)]
    spark.createDataFrame(rows, "page_id string, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc_zip.op3_warc(spark, str(tmp_path)).collect()}
    assert got == {"a": ("response", None), "b": ("revisit", "a"), "c": ("response", None)}


def test_small_payloads_are_all_responses(spark, odd_pages, tmp_path):
    packages = warc_zip.write_packages(odd_pages, f"file://{tmp_path}/w", min_revisit_bytes=100)
    assert {r.record_type for r in warc_zip.read_packages(packages).collect()} == {"response"}
    assert warc_zip.read_packages(warc_zip.write_packages(odd_pages.limit(0), f"file://{tmp_path}/e")).count() == 0


# --- media ---


def test_images_hold_their_bytes():
    for text in (None, "", "x", "é" * 1000, "a" * 576):
        n, payload = media.to_payload(text)
        assert len(payload) % 576 == 0 and len(payload) > 0 and payload[:n] == (text or "").encode() and set(payload[n:]) <= {255}
        assert media.from_png(media.to_png(payload)) == payload
    bad = bytearray(media.to_png(payload))
    bad[40] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(bad))


def test_sequences_keep_order_and_captions():
    html = '<h1>T &amp; U</h1><p>one<br>two <img src="sha256:aa" alt="A"> three</p><figure><img src="sha256:bb"><img src="x.png"><figcaption>Both &lt;here&gt;</figcaption></figure><script>no</script>tail'
    got = [(p["position"], p["kind"], p["text"], p["ref"], p["caption"]) for p in media.parse_sequence(html)]
    assert got == [(0, "text", "T & U", None, None), (1, "text", "one two", None, None), (2, "media", "A", "sha256:aa", None), (3, "text", "three", None, None), (4, "media", None, "sha256:bb", "Both <here>"), (5, "media", None, "x.png", "Both <here>"), (6, "text", "tail", None, None)]


def test_references_resolve_by_digest(spark):
    d = [hashlib.sha256(x).hexdigest() for x in (b"1", b"2")]
    pages = spark.createDataFrame([(1, f'<img src="sha256:{d[0]}"><p>t</p><img src="sha256:{d[1]}">'), (2, f'<img src="sha256:{d[0]}">'), (None, None), (3, '<img src="sha256:' + "0" * 64 + '">')], "id long, html string")
    store = spark.createDataFrame([(d[0], b"1"), (d[0], b"1"), (d[1], b"2")], "digest string, payload binary")
    rows = media.resolve(media.references(media.sequences(pages, id_col="id", html_col="html")), store).collect()
    assert sorted((r.id, r.position, r.payload and bytes(r.payload)) for r in rows) == [(1, 0, b"1"), (1, 2, b"2"), (2, 0, b"1"), (3, 0, None)]


def test_stored_documents(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op4_media(spark, str(tmp_path)).collect()
    assert len(got) == odd_docs.count()
    want = []
    for r in odd_docs.collect():
        n, p = media.to_payload(r.text)
        want.append((r.doc_id or 0, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media.to_png(p)), hashlib.sha256(media.to_png(p)).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == sorted(want)
    no_docs.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert media.op4_media(spark, str(tmp_path / "none")).count() == 0


# --- page text ---


def test_article_without_the_rest():
    html = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use</div>
    <header>Site</header><main><article><header><h1>Head&eacute;r</h1></header><p>One <b>two<br>three</p><p>x &amp; y&nbsp;z<script>var a="</p>";</script></p><div class="ad">Buy</div><!-- <p>gone</p> -->
    <pre>a   b</pre><section id="comments"><p>nice post</p></section><form><p>mail</p></form><p title="a > b">last</p></article></main><aside>side</aside><footer>&copy;</footer></body></html>"""
    assert page_text.blocks(html)[0] == ["Headér", "One two three", "x & y z", "a b", "last"]
    for broken in ("<", "<p", "<!--", "</", "<p>a<b>c</p", "&am", "<div><p>" * 2000, "<a href='", '<script>x'):
        page_text.blocks(broken)
    assert page_text.blocks(None) == ([], [], []) and page_text.blocks("plain &lt;text")[1] == ["plain <text"]


def test_main_text_is_not_taken_for_marked():
    text = ["Long story", "It goes on"]
    body = "<h1>Long story</h1><p>It goes on</p>"
    for wrapper in ('div style="overflow:hidden"', 'div class="layout sidebar-right"', 'div title="The hidden costs"', 'div data-id="comment"', "form", 'div class="search"', 'a href="/en/hidden-valleys"'):
        assert page_text.blocks(f"<{wrapper}><article>{body}</article></{wrapper.split()[0]}>")[0] == text, wrapper
        if wrapper not in ("form", 'div class="search"'):
            assert page_text.blocks(f"<article><{wrapper}>{body}</{wrapper.split()[0]}></article>")[0] == text, wrapper
    assert page_text.blocks('<article><section id="search"><p>a</p></section><h2 id="related-work">b</h2><svg/><p>c</p><math display="x"/><p>d</p></article>')[0] == ["a", "b", "c", "d"]
    for out in ("<div hidden>", '<div class="site-footer">', '<div class="comment-list"><article>', '<div class="related-posts"><article>', '<div class="cookie-notice">', '<nav><article>', '<div aria-hidden="true">', '<div class="x ad">'):
        assert page_text.blocks(f"{out}gone")[0] == [] == page_text.blocks(f"{out}gone")[1], out


def test_suffix_array_orders_prefixes():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, 300)
    order, rank = page_text.suffix_order(codes, 6)
    keys = [tuple(codes[i : i + 6]) + (-1,) * (6 - len(codes[i : i + 6])) for i in range(300)]
    assert all((keys[i] < keys[j]) == (rank[i] < rank[j]) for i in range(0, 300, 7) for j in range(0, 300, 5) if i < 295 and j < 295)
    assert [rank[i] for i in order] == sorted(rank)


def test_intervals_equal_counting():
    rng = np.random.default_rng(1)
    streams = [[f"t{k}" for k in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(30)]
    prefix, least, most = page_text.intervals(streams, list(range(30)))
    want = {}
    for p, s in enumerate(streams):
        for h in page_text.prefixes(s):
            lo, hi = want.get(h, (p, p))
            want[h] = (min(lo, p), max(hi, p))
    assert {int(h): (int(a), int(b)) for h, a, b in zip(prefix, least, most)} == {int(h): v for h, v in want.items()}


@pytest.mark.parametrize("tokens", [400_000, 40])
def test_host_boilerplate_goes_and_unique_runs_stay(spark, monkeypatch, tokens):
    monkeypatch.setattr(page_text, "SHARD_TOKENS", tokens)
    banner = "read all about our great offers today and tomorrow"
    rows = [(i, f"http://h.com/{i}", f"<div>{banner}</div><div>unique story {i} has {i}a {i}b of its {i * 7} end</div><p>Menu</p>") for i in range(12)]
    rows += [(50, "http://other.com/", f"<div>{banner}</div>"), (51, "http://h.com/a", f"<nav>{banner}</nav><article><p>{banner} once more</p></article>"), (52, "http://h.com/0copy", rows[0][2]), (53, None, None), (None, "http://h.com/x", "")]
    got = {r.page_id: r for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"unique story {i} has {i}a {i}b of its {i * 7} end" for i in range(12))
    assert got[50].text == banner and got[51].text == banner + " once more" and got[52].text == got[0].text
    assert got[53].text == "" and got[None].n_chars == 0 and got[0].n_chars == len(got[0].text)


@pytest.mark.parametrize("tokens", [400_000, 40])
def test_shared_text_is_not_boilerplate(spark, monkeypatch, tokens):
    monkeypatch.setattr(page_text, "SHARD_TOKENS", tokens)
    body = "\n".join(" ".join(f"k{j}x{i}" for i in range(20)) for j in range(3))
    story = "".join(f"<p>{x}</p>" for x in body.split("\n"))
    # one text under other menus, and under other adverts in the open
    rows = [(i, f"<nav>menu {i} of the site with links</nav>{story}") for i in range(8)] + [(i, f"<div>offer {i} only today for you and {i}</div>{story}") for i in range(8, 16)]
    # a phrase and a heading that two pages share
    rows += [(i, f"<p>In brief</p><p>at the end of the day we saw page {i} and its {i} words</p>") for i in (20, 21)]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame([(i, f"http://h.com/{i}", h) for i, h in rows], "page_id long, url string, html string")).collect()}
    assert all(got[i] == body for i in range(8)) and all(got[i].endswith(body) for i in range(8, 16))
    assert all(got[i] == f"In brief\nat the end of the day we saw page {i} and its {i} words" for i in (20, 21))


def test_names_inside_an_article():
    for kept in ('<p id="reply">', '<section id="comment">', '<h2 class="search">', '<p class="share">', '<p class="comment">', '<p class="alert">', "<math>", "<noscript>"):
        tag = kept[1:-1].split()[0]
        assert page_text.blocks(f"<article><p>a</p>{kept}kept</{tag}></article>")[0] == ["a", "kept"], kept
    for doubt in ('<div class="menu">', "<aside>", '<div class="share">', '<ul class="sidebar">'):
        tag = doubt[1:-1].split()[0]
        assert page_text.zoned(f"<article><p>a</p>{doubt}soup</{tag}><p>b</p></article>") == [("in", "a"), ("doubt", "soup"), ("in", "b")], doubt
    for out in ('<div class="ad">', '<p class="sponsored">', '<section id="comments">', "<form>", '<div class="comment-list">', "<nav>"):
        tag = out[1:-1].split()[0]
        assert page_text.zoned(f"<article><p>a</p>{out}gone</{tag}></article>") == [("in", "a"), ("marked", "gone")], out
    assert page_text.zoned("<article><p>a</p></article><p>rest</p><aside>x</aside>") == [("in", "a"), ("open", "rest"), ("marked", "x")]


def plainly(rows):
    """The text of each row of (page_id, url, html), by counting every run of tokens page by page."""
    host = lambda u: (u or "").split("://", 1)[-1].split("/")[0].lower() if "://" in (u or "") else ""
    pages, of = {}, {}
    for _, url, html in rows:
        found = page_text.zoned(html)
        own = (tuple(b for z, b in found if z == "in"), tuple(b for z, b in found if z == "open"))
        for z, b in found:
            if z != "in":
                of.setdefault(host(url), set()).add(own)
                words = b.split()
                runs = {tuple(words)} if len(words) < page_text.RUN else {tuple(words[i : i + page_text.RUN]) for i in range(len(words) - page_text.RUN + 1)}
                for run in runs:
                    pages.setdefault((host(url), run), set()).add(own)
    texts = []
    for i, url, html in rows:
        found, n = page_text.zoned(html), len(of.get(host(url), ()))

        def boiler(run):
            held = len(pages.get((host(url), run), ()))
            return held >= page_text.PAGES and 100 * held >= page_text.SHARE * n and (len(run) >= page_text.RUN or 100 * held >= page_text.SHORT_SHARE * n)

        gone = []
        for z, b in found:
            if z in ("open", "doubt"):
                words = b.split()
                flags = [False] * len(words)
                width = min(page_text.RUN, len(words))
                for at in range(len(words) - width + 1):
                    if boiler(tuple(words[at : at + width])):
                        flags[at : at + width] = [True] * width
                gone += flags
        total = len(gone) + sum(len(b.split()) for z, b in found if z == "in")
        at = 0
        while at < len(gone):
            end = at
            while end < len(gone) and gone[end]:
                end += 1
            if 2 * (end - at) > total:
                gone[at:end] = [False] * (end - at)
            at = max(end, at + 1)
        left, flags = [], iter(gone)
        for z, b in found:
            if z == "in":
                left.append(b)
            elif z != "marked":
                rest = [w for w in b.split() if not next(flags)]
                if rest and (z == "open" or n >= page_text.PAGES):
                    left.append(" ".join(rest))
        texts.append((i, "\n".join(left)))
    return texts


@pytest.mark.parametrize("tokens", [400_000, 60])
def test_extraction_equals_counting(spark, monkeypatch, tokens):
    monkeypatch.setattr(page_text, "SHARD_TOKENS", tokens)
    rng = np.random.default_rng(5)
    shared = [" ".join(f"s{j}w{i}" for i in range(n)) for j, n in enumerate((3, 6, 9, 14))]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.integers(1, 7)):
            own = " ".join(f"u{k}" for k in rng.integers(0, 60, rng.integers(1, 16)))
            text = (own, shared[rng.integers(4)], own + " " + shared[rng.integers(4)])[rng.integers(3)]
            parts.append(("<p>{}</p>", '<div class="menu">{}</div>', "<aside>{}</aside>", "<article><p>{}</p></article>", '<article><div class="menu">{}</div><p>x y</p></article>', "<nav>{}</nav>")[rng.integers(6)].format(text))
        rows.append((i, f"http://h{rng.choice([0, 0, 0, 1, i])}.com/{i}", "".join(parts)))
    rows += [(200 + i, *rows[i][1:]) for i in range(5)] + [(300, None, None), (301, "http://h0.com/", ""), (302, None, "<p>alone</p>")]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted(plainly(rows))
    # the arrays decide: without them, all that is open or in doubt would be there
    everything = {i: "\n".join(b for z, b in page_text.zoned(h) if z in ("in", "open", "doubt")) for i, _, h in rows}
    assert sum(r.text != everything[r.page_id] for r in got) > 20


def test_text_of_odd_pages(spark, odd_pages):
    got = page_text.extract(odd_pages).collect()
    assert len(got) == odd_pages.count() and next(r for r in got if r.page_id == 5).text == " ".join(["word"] * 50_000)
    assert page_text.extract(odd_pages.limit(0)).count() == 0


# --- URLs ---


def test_literal_tokens_and_patterns():
    assert url_filter.literal_tokens("||example.com/en/*") == ["example", "com", "en"]
    assert url_filter.literal_tokens("*/download/*.exe^") == ["download", "exe"]
    assert url_filter.literal_tokens("*abc*") == []


def judged(spark, urls, rules):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}


def test_longest_rule_wins_over_subdomains(spark):
    got = judged(spark, ["http://example.com/en/x?q", "https://www.example.com/en/", "x://a.b.com", "a://N.net/es/1", "a://net/fr/", "a://xnet/fr/", "a://com.org/", None, "nothing", "a://HOST:80/p#f", "http://h.com://x/y", "a://example.com/EN/"], url_filter.HOST_RULES)
    assert got["http://example.com/en/x?q"] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got["https://www.example.com/en/"][2:] == ("www.example.com/en/", "allow")
    assert got["x://a.b.com"] == ("a.b.com", "", None, "allow")
    assert got["a://N.net/es/1"] == ("n.net", "/es/1", "net/es/", "block")
    assert got["a://net/fr/"][2] == "net/fr/" and got["a://xnet/fr/"][2] is None and got["a://com.org/"][2] is None
    assert got[None] == ("", "", None, "allow") and got["nothing"][:2] == ("", "") and got["a://HOST:80/p#f"][:2] == ("host:80", "/p")
    assert got["a://example.com/EN/"][2] == "com/"


def test_rules_without_tokens_and_ties(spark):
    rules = [url_filter.Rule("any", "*zz*", "block"), url_filter.Rule("a", "||x.com*", "allow", 1), url_filter.Rule("b", "||x.com*", "block", 1)]
    got = judged(spark, ["http://q.org/azza", "http://x.com/zz", "http://q.org/a"], rules)
    assert got["http://q.org/azza"][2:] == ("any", "block") and got["http://x.com/zz"][2:] == ("b", "block") and got["http://q.org/a"][3] == "allow"
    assert judged(spark, [], rules) == {}


def test_no_python_in_native_plans(spark):
    from stratocline.llm import registry

    for name in ("op5_decontaminate", "op6_url_filter"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))
