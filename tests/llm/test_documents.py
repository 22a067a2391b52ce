"""SetSketch near-duplicates, line dedup, mixing, decontamination, quality, tokens: contracts, edges, brute force."""

import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocline.llm import byte_cnn, decontaminate, hashing, line_dedup, linking, mixing, setsketch, token_tree

DATA = "/root/testdata/sf0.001"


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- near-duplicates ---


def test_hashes_follow_the_words():
    texts = [b"A b  c\x0bd", b"", b"a B c d ", "é x".encode(), b"z" * 3]
    words, at = hashing.word_hashes(texts)
    assert list(np.diff(at)) == [4, 0, 4, 2, 1]
    assert (words[:4] == words[4:8]).all() and len(set(words[:4])) == 4


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"t{i}" for i in range(3000)).encode()
    whole, _ = hashing.word_hashes([text])
    monkeypatch.setattr(hashing, "PIECE", 100)
    parts, at = hashing.word_hashes([text, b"x" * 500])
    assert (parts[:3000] == whole).all() and list(np.diff(at)) == [3000, 1]


def test_sketches_estimate_similarity_and_merge():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    s = setsketch.sketches([a, b, np.union1d(a, b)])
    assert (setsketch.merge(s[0], s[1]) == s[2]).all()
    got, possible = setsketch.estimate(s[:1], s[1:2], np.array([2000]), np.array([2000]), 0.8)
    assert abs(got[0] - 0.6) < 0.15
    same = setsketch.estimate(s[:1], s[:1], np.array([2000]), np.array([2000]), 0.8)
    assert same[0][0] > 0.95 and same[1][0]
    far = setsketch.sketches([pool[:50], pool[60:110]])
    assert not setsketch.estimate(far[:1], far[1:], np.array([50]), np.array([50]), 0.8)[1][0]


def brute(rows, width, percent):
    sets = [setsketch.shingles(t, width) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = components(len(rows), links)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None] if sets[i] else [doc]
        low = min(ids) if ids else None
        out.append((doc, len(sets[i]), low, doc == low))
    return Counter(out)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, odd_docs, width):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = setsketch.near_duplicates(odd_docs, width=width)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, width, 80)


def test_chains_and_large_groups(spark):
    """A chain of texts each close to the next, and a group of near copies with a pivot that is far from some."""
    rng = random.Random(3)
    base = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(base)))
        base = base[2:] + [f"n{i}a", f"n{i}b"]
    root = [f"g{i}" for i in range(120)]
    for i in range(150):
        own = list(root)
        for k in rng.sample(range(120), rng.randint(1, 7)):
            own[k] = f"x{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in setsketch.near_duplicates(df, width=2).collect()) == brute(rows, 2, 80)


def test_blocks_find_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 16)
    rows = [(k, n, n % 3, bytes([n])) for k, size in ((1, 100), (2, 3)) for n in range(size)]
    df = spark.createDataFrame(rows, "key long, node long, comp long, payload binary").repartition(3)
    got = Counter(tuple(r) for r in linking.block_pairs(df, lambda p, x, y, key: np.ones(len(x), bool)).collect())
    want = {(a, b) for a in range(100) for b in range(a + 1, 100) if a % 3 != b % 3}
    assert set(got) == want


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "a long, b long")
    assert {(r.node, r.comp) for r in linking.components(df).collect()} == {(n, 0) for n in range(60)}


def test_no_documents(spark, no_docs):
    assert setsketch.near_duplicates(no_docs).count() == 0
    assert line_dedup.dropped_lines(no_docs).count() == 0
    assert line_dedup.without_lines(no_docs, line_dedup.dropped_lines(no_docs)).columns == no_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.emit(no_docs).count() == 0
    assert token_tree.count_with_edits(no_docs).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(no_docs, bench).count() == 0


# --- lines ---


def brute_lines(docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0]))
    places = [(d, i, x) for d, t in docs for i, x in line_dedup._lines(t)]
    texts = sorted({x for _, _, x in places})
    sets = [line_dedup.shingles(x) for x in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = dict(zip(texts, components(len(texts), links)))
    keep = {}
    for d, i, x in places:
        keep.setdefault(comp[x], (d, i))
    gone = {}
    for d, i, x in places:
        if keep[comp[x]] != (d, i):
            gone.setdefault(d, set()).add(i)
    return {d: sorted(v) for d, v in gone.items()}


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 8)):
            x = rng.choice(pool)
            if rng.random() < 0.4:
                w = x.split()
                w[rng.randrange(len(w))] = "swapped"
                x = " ".join(w)
            lines.append(rng.choice([x, x.upper(), "  " + x, ""]))
        rows.append((d, "\n".join(lines)))
    rows += [(None, pool[0]), (200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: list(r.dropped) for r in line_dedup.dropped_lines(df).collect()} == brute_lines(rows)


def test_lines_at_the_threshold_share_a_bucket():
    """Pairs at similarity 0.80 to 0.85 meet in a band, and the bins that agree do not rule them out."""
    rng = random.Random(12)
    lines = []
    while len(lines) < 6000:
        size = rng.choice((20, 40, 60, 100, 200))
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        for cut in range(1, size // 4):
            x, y = line_dedup.shingles(a), line_dedup.shingles(a[:-cut])
            if 80 * len(x | y) <= 100 * len(x & y) <= 85 * len(x | y):
                lines += [a, a[:-cut]]
    bins = line_dedup.signatures(lines)
    same = bins[::2] == bins[1::2]
    met = same.reshape(len(same), line_dedup.BANDS, line_dedup.ROWS).all(2).any(1)
    assert met.all() and (same.sum(1) >= 2 * line_dedup.BINS // 5).all()


def test_lines_of_odd_documents(spark, odd_docs):
    dropped = line_dedup.dropped_lines(odd_docs)
    by = {r.doc_id: list(r.dropped) for r in dropped.collect()}
    assert by[13] == [2] and 1 not in by and by[2] == [0]
    out = line_dedup.without_lines(odd_docs, dropped)
    assert out.columns == odd_docs.columns
    kept = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert kept[13].text == "line a of text here\n\nother line of this text" and kept[13].n_chars == len(kept[13].text)
    assert 2 not in kept and kept[4].text is None and kept[5].text == ""


# --- mixing ---


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        over = [s for s in free if left * w[s] > most * sizes[s] * sum(w[x] for x in free)]
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)


def test_targets_and_words_taken(spark):
    rng = random.Random(2)
    sizes = {"a": 30, "b": 400, "c": 20, None: 300, "é": 60, "z": 3, "empty": 5}
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)) if s != "empty" else None, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = brute_targets({s: size[s] for s in sizes})
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == size[r.source]
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 120 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.emit(df).count() == sum(r.copies for r in got)


def test_mixing_odd_documents(spark, odd_docs):
    got = mixing.mix(odd_docs)
    assert got.count() == odd_docs.count()
    out = mixing.emit(odd_docs)
    assert out.columns == [*odd_docs.columns, "copy_no"] and out.where("copy_no > 3").count() == 0


# --- linking ---


def test_buckets_equal_plain_grouping(spark):
    """Each bucket comes back whole and connected, over tasks, batches and keys that share their lower half."""
    rng = np.random.default_rng(3)
    parts, n, bands = 16, 20_000, 3
    low = rng.integers(0, 3000, (n, bands)).astype(np.uint64) * np.uint64(1 << 20)
    keys = (rng.integers(0, 40, (n, bands)).astype(np.uint64) << np.uint64(58)) | low
    keys[rng.random(n) < 0.3, 0] = np.uint64(7)  # a third of all rows in one bucket
    node = rng.permutation(n).astype(np.int64) * 3 + 1
    plain = {}
    for b in range(bands):
        for k, x in zip(linking.bucket_key(keys[:, b], parts).tolist(), node.tolist()):
            plain.setdefault(k, set()).add(x)
    rows = [r for s in range(0, n, 5000) for b in linking.packed(node[s : s + 5000], keys[s : s + 5000], parts) for r in b.to_pylist()]
    made = spark.createDataFrame([(r["part"], bytearray(r["heads"]), bytearray(r["near"])) for r in rows], linking.PACKED).repartition(5)
    found = {}
    for key, x, pivot in linking.buckets(made).collect():
        found.setdefault(key, []).append((x, pivot))
    assert set(found) == {k for k, v in plain.items() if len(v) > 1}
    for key, edges in found.items():
        members = sorted({x for e in edges for x in e})
        at = {x: i for i, x in enumerate(members)}
        assert set(members) == plain[key] and len(set(components(len(members), [(at[a], at[b]) for a, b in edges]))) == 1


def test_strays_of_a_giant_are_linked_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 8)
    monkeypatch.setattr(linking, "SMALL", 3)
    giant, strays = 40, 20
    true = [(0, i) for i in range(1, giant)] + [(5, 40), (41, 42), (43, 44), (44, 45), (41, 46), (37, 47), (47, 48), (12, 40), (58, 59)]
    links = spark.createDataFrame(true, "a long, b long")
    members = linking.cut(spark.createDataFrame([(9, i, 0) for i in range(giant + strays)] + [(10, 50, 50), (10, 51, 50)], "key long, node long, pivot long"))
    asked = []

    def confirm(pairs):
        asked.extend((r["a"], r["b"]) for r in pairs.select("a", "b").collect())
        return pairs.join(links, ["a", "b"])

    def payload(nodes):
        return nodes.select("node", F.col("node").cast("string").cast("binary").alias("payload"))

    got = {r["node"]: r["comp"] for r in linking.link(members, confirm, payload, lambda held, x, y, key: np.ones(len(x), bool)).collect()}
    want = dict(enumerate(components(giant + strays, true)))
    assert {i: got.get(i, i) for i in want} == want
    # each pair once, none within the giant but its pivot's
    assert len(asked) == len(set(asked)) and not any(0 < a and b < giant for a, b in asked)
    assert {(a, b) for a in range(1, giant + strays) for b in range(max(giant, a + 1), giant + strays)} <= set(asked)


# --- decontamination ---


def test_leaks_survive_substitutions_case_and_marks(spark, odd_docs):
    rng = random.Random(4)
    item = [f"q{i}" for i in range(30)]
    noise = [f"n{i}" for i in range(500)]

    def around(words):
        return " ".join(noise[:40] + words + noise[40:80])

    changed = list(item)
    for k in (4, 13, 22):
        changed[k] = "other"
    half = [w if i % 2 else rng.choice(noise) for i, w in enumerate(item)]
    rows = [(1, around(item)), (2, around([w.upper() + "!!" for w in item])), (3, around(changed)), (4, around(item[:16])), (5, around(half)), (6, around(item[:8])), (7, None), (None, around(item)), (1, "repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (None, " ".join(noise[400:430])), (3, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_token, r.aligned, r.matched) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(1, 1): (40, 30, 30), (2, 1): (40, 30, 30), (3, 1): (40, 30, 27), (4, 1): (40, 30, 16), (None, 1): (40, 30, 30)}
    left = decontaminate.without_leaks(docs, bench)
    assert {r.doc_id for r in left.collect()} == {5, 6, 7}
    assert decontaminate.without_leaks(odd_docs, bench).count() == odd_docs.count()


def test_overlaps_equal_sql_without_seeds(spark, tmp_path):
    rng = random.Random(11)
    names = [f"v{i}" for i in range(30)]
    items = {n: [rng.choice(names) for _ in range(size)] for n, size in enumerate([1, 1, 2, 4, 5, 9, 9, 12, 12, 15, 18, 31])}
    items[0] = ["often"]
    rows = []
    for n in range(150):
        part = list(items[n % len(items)])
        for k in rng.sample(range(len(part)), len(part) * rng.choice([0, 10, 20, 25]) // 100):
            part[k] = f"other{k}"
        rows.append((n, " ".join([rng.choice(names + ["often"] * 40) for _ in range(rng.randint(0, 40))] + part + [rng.choice(names) for _ in range(rng.randint(0, 40))])))
    rows += [(500, None), (501, ""), (502, "often " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()] + [(90, None), (91, " ... ")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = decontaminate.op5_decontaminate(spark, str(tmp_path))
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(con.execute(decontaminate.OP5_SQL).fetchall())
    assert {n for _, n, *_ in got} == set(items) and (502, 0, 19_999, 1, 1, 1) in got


def test_masks_hit_all_placings():
    """Of every placing of the mismatches that a window allows, some mask at some place meets none."""
    for length in range(1, decontaminate.WINDOW + 1):
        wrong = length * (100 - decontaminate.PERCENT) // 100
        masks = decontaminate.LOSSLESS[max(k for k in decontaminate.LOSSLESS if k <= length)]
        for bad in combinations(range(length), wrong):
            assert any(all(m[i] == "0" or at + i not in bad for i in range(len(m))) for m in masks for at in range(length - len(m) + 1)), (length, bad)


def test_overlaps_equal_all_alignments(spark):
    rng = random.Random(8)
    names = [f"v{i}" for i in range(40)]
    items = {n: [rng.choice(names) for _ in range(size)] for n, size in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 12, 13, 14, 15, 16, 20, 33])}
    docs = {}
    for n in range(160):
        item = items[n % len(items)]
        part = list(item[: rng.randint(12, 40)])
        for k in rng.sample(range(len(part)), len(part) * rng.randint(0, 25) // 100):
            part[k] = f"other{k}"
        docs[n] = [f"d{rng.randrange(900)}" for _ in range(rng.randint(0, 12))] + part + [f"d{rng.randrange(900)}" for _ in range(rng.randint(0, 12))]

    def best(doc, item):
        width, found = min(decontaminate.WINDOW, len(item)), []
        for shift in range(-len(item), len(doc) + 1):
            low, high = max(0, -shift), min(len(item), len(doc) - shift)
            same = [item[i] == doc[i + shift] for i in range(low, high)]
            window = max([sum(same[i : i + width]) for i in range(len(same) - width + 1)], default=0)
            if 100 * window >= decontaminate.PERCENT * width:
                found.append((sum(same), window, high - low, low + shift))
        return max(found, default=None)

    want = {(d, i): b for d, doc in docs.items() for i, item in items.items() if (b := best(doc, item))}
    frames = [spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{name} long, text string") for x, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): (r.matched, r.window_matched, r.aligned, r.doc_token) for r in decontaminate.overlaps(*frames).collect()}
    assert got == want


# --- quality ---


def test_network_learns_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    model = byte_cnn.train(docs, labels)
    held = byte_cnn.score(docs.join(labels, "doc_id").where(byte_cnn.held_out(F.col("doc_id"))), model).select("quality", "score").collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in held]) > 0.95


def test_gradients_match_differences():
    m = {k: v.astype(np.float64) for k, v in byte_cnn.new_model(1).items()}
    texts, y = [b"hello world " * 30, b"!!! $$$ ### " * 40, b""], np.array([1.0, 0.0, 1.0])
    g = byte_cnn.gradients(m, texts, y, np.ones(3))

    def loss(model):
        buf, starts = byte_cnn.segments(texts)
        p = byte_cnn.forward(model, byte_cnn.pooled(model, buf).astype(np.float64), starts)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, at in (("w", (3,)), ("W", (2, 5)), ("b", (0,)), ("d", (4,))):
        up, down = ({k: v.copy() for k, v in m.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[name][at]) < 1e-3


def test_scores_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (11, 0, 0), (None, 1, 0), (3, None, 0), (500, 0, 1)], "doc_id long, quality int, toxic int")
    model = byte_cnn.train(odd_docs, labels)
    got = byte_cnn.score(odd_docs.select("doc_id", "text"), model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert byte_cnn.train(no_docs, labels) is None
    assert {r.score for r in byte_cnn.score(odd_docs.select("doc_id", "text"), None).collect()} == {0.5}


def test_long_texts_score_the_same_in_slices(monkeypatch):
    m, text = byte_cnn.new_model(), "".join(chr(97 + i % 23) for i in range(50_000))
    whole = byte_cnn.score_texts(m, [text, "short", None])
    monkeypatch.setattr(byte_cnn, "SLICE", 16)
    assert np.allclose(byte_cnn.score_texts(m, [text, "short", None]), whole, atol=1e-6)


def test_held_out_fold(spark):
    rows = spark.range(50).select("id", byte_cnn.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


# --- tokens ---


def test_edits_equal_full_encoding():
    counter, rng = token_tree.Counter(), random.Random(1)
    texts = ["", " ", "a", "  \n\n x  ", "It's 12 o'clock, isn't it?  \n\n done" * 9, "é" * 300 + " " * 40 + "x" * 300, "word " * 500]
    for text in texts:
        tree = token_tree.TokenTree(text, counter)
        for _ in range(60):
            a = rng.randint(0, len(text) + 3)
            b = a + rng.choice([-2, 0, 0, 1, 5, 50, 900])
            new = rng.choice(["", "x", " revised", "\n\n  ", "'s", "   ", "12 34", "é" * 5, "word " * 60])
            tree.edit(a, b, new)
            a = min(a, len(text))
            b = min(max(a, b), len(text))
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.length == len(text)
            assert tree.total == len(counter.encoding.encode_ordinary(text))


def test_counts_of_odd_documents(spark, odd_docs):
    encoding = token_tree.Counter().encoding
    got = token_tree.count_with_edits(odd_docs, edits=token_tree.sample_edits(F.col("text"))).collect()
    plain = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    want = []
    for i, t in plain:
        after = t[: len(t) // 2] + " revised" + t[len(t) // 2 :]
        k, n = len(t) // 3, len(t)
        after = after[:k] + after[k + 24 :]
        after = after[:n] + "\nEnd of the edited text." + after[n + 8 :]
        want.append((i, len(encoding.encode_ordinary(t)), len(encoding.encode_ordinary(after))))
    assert Counter((r.doc_id, r.n_tokens, r.n_tokens_after) for r in got) == Counter(want)
    long = next(r for r in got if r.doc_id == 11)
    assert long.reencoded_pretokens < 0.01 * long.n_pretokens
