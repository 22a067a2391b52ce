"""Token alignment, the pigeonhole join of vectors and the filter audit: contracts, edges, brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocline.llm import embedding_join, filter_audit, token_align

DATA = "/root/testdata/sf0.001"


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- token alignment ---

ODD = [
    None, "", "a", "a  b", "  x", "x\n y\n\nz ", "tab\t\tx \n", "<|endoftext|> hi </s> <unk> <s>", "héllo wörld 日本語 😀", "a▁b", "▁", "ﬁ ½ ①", "it's we'll 12345 !!! ??", "\r\n x", "a" * 300,
    " ", "\n", "  \n  ", "é" * 50 + "\n" * 5, "\x00\x01 x", "the cat sat on the mat", "the cat sat on the mat", "The cat, the dog.\nthe end",
]


def reference_alignment(texts):
    """All rows by the tokenizers' own interfaces and pairs of byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(token_align.FIRST)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=token_align.SECOND)
    letters = token_align.byte_letters()
    made = []
    for t in texts:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        parts = [bytes(letters[c] for c in one.id_to_token(i)) for i in a], [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            made.append((0, 0, "", Counter()))
            continue
        x, y = ([(sum(map(len, p[:k])), sum(map(len, p[: k + 1]))) for k in range(len(p))] for p in parts)
        links = Counter((i, j) for i, (s, e) in zip(a, x) for j, (u, v) in zip(b, y) if s < v and u < e)
        both = sorted({e for _, e in x} & {e for _, e in y})
        groups, low = [], 0
        for e in both:
            groups.append("|".join(",".join(str(i) for i, (_, f) in zip(ids, at) if low < f <= e) for ids, at in ((a, x), (b, y))))
            low = e
        made.append((len(a), len(b), ";".join(groups), links))
    held = Counter(k for *_, links in made for k in links)
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (n_a, n_b, len(g.split(";")) if g else 0, links.total(), hashlib.sha256(g.encode()).hexdigest() if g else "", sum(n for k, n in links.items() if held[k] == most[k[0]]), sum(n * held[k] for k, n in links.items()))
        for n_a, n_b, g, links in made
    ]


def test_alignment_equals_all_pairs_of_ranges(spark):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 1500").select("text").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("pairs", F.lit(1))
    out = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in token_align.align(df).collect()}
    want = reference_alignment(texts)
    assert out == dict(enumerate(want))


def test_alignment_of_whole_table_gives_back_all_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = token_align.op11_token_alignment(spark, DATA)
    assert out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = reference_alignment([texts[k] for k in sorted(texts) if len(texts[k] or "") < 800])
    short = [k for k in sorted(texts) if len(texts[k] or "") < 800]
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in out.collect()}
    assert [got[k] for k in short] == [w[:5] for w in want]


def test_alignment_on_odd_tables(spark, odd_docs, no_docs):
    out = token_align.align(odd_docs)
    assert out.count() == odd_docs.count()
    nulls = [r for r in out.collect() if r["doc_id"] in (4, 5)]
    assert all(r["n_links"] == 0 and r["groups_sha256"] == "" and r["count_sum"] == 0 for r in nulls) and len(nulls) == 2
    assert token_align.align(no_docs).count() == 0


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    key = np.unique((rng.integers(0, 50_000, 1000) << 32) | rng.integers(0, 32_000, 1000))
    n = rng.integers(1, 99, len(key))
    assert all((x == y).all() for x, y in zip(token_align.unpacked(token_align.packed(key, n)), (key, n)))


def test_counts_flush_and_shards_hold_each_key_once(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(2)
    rows = [np.unique((rng.zipf(1.5, 200) % 300 << 32) | (rng.zipf(1.5, 200) % 200)) for _ in range(150)]
    want = Counter(int(k) for r in rows for k in r)
    df = spark.createDataFrame([(bytearray(token_align.packed(r, np.ones(len(r), int))),) for r in rows] + [(None,)], "pairs binary").repartition(4)
    listed = token_align.write_shards(token_align.partial_counts(df), f"file://{tmp_path}/shards")
    found = token_align.Shards(listed)
    keys = np.array(sorted(want))
    n, most = found.find(keys)
    best = defaultdict(int)
    for k, v in want.items():
        best[k >> 32] = max(best[k >> 32], v)
    assert n.tolist() == [want[int(k)] for k in keys] and most.tolist() == [best[int(k) >> 32] for k in keys]
    assert len(listed) > 1 and all(a[1] >> 32 < b[0] >> 32 for a, b in zip(listed, listed[1:]))


# --- vectors ---


def planted(size, seed, n=160):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    for k in range(40, 110):  # near the threshold on both sides
        c = rng.uniform(0.86, 0.94)
        u = x[k % 20] / np.linalg.norm(x[k % 20])
        w = rng.normal(size=size)
        w -= (w @ u) * u if size > 1 else 0
        x[k] = (c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w)) * rng.uniform(0.1, 9)
    x[110:125] = x[0] * 2.0 ** rng.integers(-3, 3, 15)[:, None]
    x[125:130] = x[1]
    return x


def brute(vectors, cosine=0.9):
    """n_links, component and kept of (id, vector)."""
    good = []
    for _, v in vectors:
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        good.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    links = defaultdict(set)
    for i, x in enumerate(good):
        for j in range(i):
            y = good[j]
            if x is not None and y is not None and len(x) == len(y) and (x @ y) / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (name, _) in enumerate(vectors):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [vectors[k][0] for k in seen if vectors[k][0] is not None]
        low = min(ids) if ids else None
        out.append((name, len(links[i]), low, name == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 3, 24, 64, 100])
def test_vectors_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(embedding_join, "PART", 40)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(planted(size, size))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("node", F.lit(1)).withColumn("size", F.lit("x"))
    assert by_row(embedding_join.near_vectors(df)) == brute(rows)


def test_vectors_without_direction_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (2, [0.0, 0.0, 5.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [1.0, 0.0]),
        (10, [3.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 7.0, 0.0]), (None, None), (12, [-1.0, -0.0, 0.0]), (13, [1e-30, 0.0, 0.0]), (14, [0.0, 1e30, 1e29]), (15, [1.0, 0.0, 0.0]),
    ]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        assert by_row(embedding_join.near_vectors(df)) == brute(rows)
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_some_block_holds_its_share():
    """The pigeonhole itself, over pairs at the threshold."""
    x = embedding_join.units(planted(64, 5, 400))
    r = embedding_join.rotated(x)
    assert np.allclose(r @ r.T, x @ x.T)
    i, j = np.triu_indices(400, 1)
    near = (x[i] * x[j]).sum(1) >= 0.9
    d = embedding_join.block_distances(r[i[near]], r[j[near]])
    assert near.sum() > 20 and (d <= embedding_join.shares(64, 0.9) + 1e-9).any(1).all()


def test_comparing_vectors_moves_no_more_than_the_input(spark, monkeypatch):
    """Bytes shuffled follow the vectors, not the pairs of parts, and are few times theirs."""
    monkeypatch.setattr(embedding_join, "PART", 40)
    monkeypatch.setattr(embedding_join, "RUNS", 4, raising=False)
    context = spark.sparkContext._jsc.sc()

    def moved(n):
        rows = [(i, v) for i, v in enumerate(np.random.default_rng(n).normal(size=(n, 64)).tolist())]
        df = embedding_join.cut(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        seen = -1
        for after in (False, True):
            if after:
                assert embedding_join.near_vectors(df).count() == n
            context.listenerBus().waitUntilEmpty()
            listed = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
            stages = [listed.apply(k) for k in range(listed.size())]
            if not after:
                seen = max(x.stageId() for x in stages)
        return sum(x.shuffleWriteBytes() for x in stages if x.stageId() > seen)

    few, many = moved(300), moved(1200)
    assert many < 5 * few and many < 3 * 1200 * 64 * 8


def test_links_among_many_near_vectors_equal_products(spark):
    """Boxes full of pairs on both sides of the threshold, pairs in a few places of large boxes, and both in one part."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 64))
    x[:700] = x[0] + rng.uniform(0.2, 0.4, (700, 1)) * rng.normal(size=(700, 64))
    for k in range(700, 1300):
        x[k] = x[k + 600] + 0.4 * rng.normal(size=64)
    x[1300:1310] = x[5]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = u @ u.T
    assert np.abs(c - 0.9).min() > 1e-9
    n = (c >= 0.9).sum(1) - 1
    assert 100_000 < n[:700].sum() < 400_000 and 200 < (n[700:1300] > 0).sum() < 600
    got = embedding_join.near_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == n.tolist()
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in c >= 0.9])
        if (new == label).all():
            break
        label = new
    assert [r["component_id"] for r in got] == label.tolist()


def test_link_just_beyond_one_block_counts_in_the_next(spark):
    """Two vectors that differ on the second axis only, a little more than the first block's share allows, others between them there."""
    turn = embedding_join.rotated(np.eye(64))
    apart = np.sqrt(embedding_join.shares(64, 0.9)[0] + 0.9 * embedding_join.SLACK)
    rng = np.random.default_rng(4)
    z = rng.normal(size=(embedding_join.ROWS + 1, 64))
    z[-1] = z[0]
    first, second = np.full(len(z), 0.05), rng.uniform(0.001 - apart / 2, apart / 2 - 0.001, len(z))
    first[-1] -= 1e-9
    second[[0, -1]] = -apart / 2, apart / 2
    z[:, :2] = 0
    z *= (np.sqrt(1 - first**2 - second**2) / np.linalg.norm(z, axis=1))[:, None]
    z[:, 0], z[:, 1] = first, second
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(z @ turn.T)]
    wanted = brute(rows)
    assert [r for r in wanted if r[1]] == [(0, 1, 0, True), (embedding_join.ROWS, 1, 0, False)]
    assert by_row(embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == wanted


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, (2, 70))
    u, v = embedding_join.forest(a, b)
    label = {k: k for k in range(60)}
    for x, y in zip(a.tolist() * 60, b.tolist() * 60):
        label[x] = label[y] = min(label[x], label[y])
    # labels above are spread along the pairs until nothing changes
    for _ in range(60):
        for x, y in zip(a.tolist(), b.tolist()):
            label[x] = label[y] = min(label[x], label[y])
    assert dict(zip(u.tolist(), v.tolist())) == {k: n for k, n in label.items() if k != n}


# --- filter audit ---


def simulated(docs, labels):
    """Each order, filter by filter, over lists."""
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    low = {}
    for d, t, _ in docs:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > low[t]}
        rows.append((s or "", fails, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, made, shapley = [r for r in rows if r[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                made.append((part, "".join(order), k, len(left), len(gone), sum(r[1][f] for r in own) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*m, shapley[m[1][m[2] - 1]]) for m in made]
    return sorted(out, key=repr)


def test_audit_equals_a_simulation(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "a"), (1, long, "b"), (3, long, None), (None, long, ""), (4, None, "a"), (5, "", "a"), (6, "A B C", "a"), (7, "a " * 80, "b"), (8, "a " * 80 + "#", "b"),
        (9, long + " $", "b"), (10, long.upper(), "b"), (None, None, "c"), (11, "\x0b".join(f"v{i}" for i in range(50)), "c"), (12, long + "\xa0x é", "a"), (12, "other", "a"), (13, "X" + "é" * 19, "c"), (14, "X" + "é" * 18, "c"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, 1), (None, 1, 1), (9, None, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in docs], "doc_id long, text string, source string, n long, part string, A boolean").repartition(3)
    out = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert by_row(out) == simulated(docs, labels)


def test_audit_equals_its_sql_and_empty_tables_give_no_rows(spark, no_docs):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = filter_audit.op13_filter_audit(spark, DATA)
    want = c.execute(filter_audit.OP13_SQL)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(out.columns)
    assert by_row(out.select(*names)) == sorted(want.fetchall(), key=repr)
    assert filter_audit.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_on_odd_documents(spark, odd_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    assert by_row(filter_audit.audit(odd_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == simulated(rows, [])
