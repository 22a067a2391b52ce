import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_documents import brute, brute_lines, brute_targets

import corpus_pipeline
from stratocline.llm import byte_cnn, decontaminate, mixing, registry, setsketch

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL)))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_stages(spark, odd_docs):
    """Each stage keeps the columns, drops only rows of its input, and takes null, empty and repeated rows."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, odd_docs, DATA)
        assert out.columns == odd_docs.columns, name
        assert out.count() <= odd_docs.count()
        assert stage(spark, odd_docs.limit(0), DATA).count() == 0
    near = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd_docs, DATA).collect()}
    assert 1 in near and 2 not in near and {4, 5, 6, 10, 11} <= near and 12 not in near


def test_rows_of_one_id_are_judged_by_their_own_text(spark, tmp_path):
    def words(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    kind = "doc_id long, text string"
    near = [(1, words("a")), (None, words("a")), (None, words("b")), (None, words("c")), (5, words("a")), (5, words("d"))]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(near, kind), DATA).collect()
    assert sorted(r.text for r in left) == sorted(words(x) for x in "abcd")

    # equal sets of shingles would link the texts of id 8 only by the other text of that id
    other = [(7, words("e")), (8, words("f")), (8, words("e") + " more"), (9, words("f") + " more")]
    got = setsketch.near_duplicates(spark.createDataFrame(other, kind))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(7, 7), (8, 7), (8, 8), (9, 8)]

    spark.createDataFrame([(1, words("q"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leaks = [(None, words("q")), (None, words("b")), (None, None), (3, words("c"))]
    left = corpus_pipeline.decontaminated(spark, spark.createDataFrame(leaks, kind), str(tmp_path)).collect()
    assert Counter(r.text for r in left) == Counter([words("b"), None, words("c")])

    texts = [(1, words("x")), (None, "first line of its own\n" + words("x")), (None, words("y") + "\nanother line of its own"), (4, words("z") + "\n" + words("x")), (4, words("u") + "\n" + words("v"))]
    left = corpus_pipeline.lines(spark, spark.createDataFrame(texts, kind), DATA).collect()
    assert {r.text for r in left} == {texts[1][1], texts[2][1], words("z"), texts[4][1]}


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*docs.columns, "copy_no"]
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()}


# --- the whole pipeline in plain Python ---


def without_gone_lines(rows):
    gone = brute_lines([(r["doc_id"], r["text"]) for r in rows])
    out = []
    for r in rows:
        if r["doc_id"] in gone:
            text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone[r["doc_id"]])
            if not text.strip():
                continue
            r = {**r, "text": text, "n_chars": len(text)}
        out.append(r)
    return out


def leaks(text, item):
    """Whether some alignment has a window of 15 tokens, or of the whole shorter item, four fifths of which agree."""
    doc, item = ([w for w in re.split(r"[\W_]+", (x or "").lower()) if w] for x in (text, item))
    width = min(decontaminate.WINDOW, len(item))
    if not width or len(doc) < width:
        return False
    same = np.array(doc)[:, None] == np.array(item)[None, :]
    at = np.arange(len(doc) - width + 1)
    return any((100 * sum(same[at + k, i + k].astype(int) for k in range(width)) >= decontaminate.PERCENT * width).any() for i in range(len(item) - width + 1))


def copies(rows):
    """(doc_id, copy_no) by counting along each source."""
    sized = [(r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["doc_id"]) for r in rows]
    total = Counter()
    for source, size, _ in sized:
        total[source] += size
    targets, out = brute_targets(dict(total)), []
    for source in total:
        name = "\0null" if source is None else source
        at = int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:8], 16) / 2**32
        for rank, (_, doc) in enumerate(sorted((size, doc) for s, size, doc in sized if s == source), 1):
            rate = targets[source] / total[source] if total[source] else 0
            out += [(doc, n + 1) for n in range(int(at + rank * rate) - int(at + (rank - 1) * rate))]
    return sorted(out)


def test_run_equals_plain_python(spark, tmp_path):
    """Documents of the table beside planted copies, near copies, shared lines, leaks, empty and null texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60).collect()
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()]
    good = [r for r in some if len(r.text or "") > 400][:8]
    assert len(good) == 8
    planted = [good[0].text, good[1].text.rsplit(" ", 2)[0] + " another end", good[2].text + "\n" + good[3].text.split("\n")[0], f"{good[4].text} {items[0]} {good[5].text}", good[6].text.upper(), "", None, " \n\t "]
    extra = [good[0].asDict() | {"doc_id": 10_000 + i, "text": t, "n_chars": None if t is None else len(t), "source": None if i % 2 else good[0].source} for i, t in enumerate(planted)]
    rows = [r.asDict() for r in some] + extra
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = byte_cnn.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = byte_cnn.score_texts(model, [r["text"] for r in rows])
    assert np.abs(scores - byte_cnn.THRESHOLD).min() > 1e-6
    steps = [[r for r, x in zip(rows, scores) if x >= byte_cnn.THRESHOLD]]
    steps.append(without_gone_lines(steps[-1]))
    kept = {doc for doc, _, _, kept in brute([(r["doc_id"], r["text"]) for r in steps[-1]], 5, 80) if kept}
    steps.append([r for r in steps[-1] if r["doc_id"] in kept])
    steps.append([r for r in steps[-1] if not any(leaks(r["text"], x) for x in items)])
    # the fixture gives every stage something to do
    assert len(rows) > len(steps[0]) and steps[1] != steps[0] and len(steps[3]) < len(steps[2])
    assert sorted((r.doc_id, r.copy_no) for r in got) == copies(steps[-1])
    left = {r["doc_id"]: r for r in steps[-1]}
    assert all({c: r[c] for c in docs.columns} == left[r.doc_id] for r in got)


def test_quality_and_mix_take_odd_documents(spark, odd_docs, no_docs):
    """Null, empty, long and repeated rows, and columns named like inner ones; an empty table stays empty."""
    out = corpus_pipeline.quality(spark, odd_docs, DATA)
    assert out.columns == odd_docs.columns
    model = byte_cnn.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = odd_docs.collect()
    want = [r for r, x in zip(rows, byte_cnn.score_texts(model, [r.text for r in rows])) if x >= byte_cnn.THRESHOLD]
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, want))
    mixed = corpus_pipeline.mixed(spark, odd_docs, DATA)
    assert mixed.columns == [*odd_docs.columns, "copy_no"]
    taken = Counter()
    for r in mixing.mix(odd_docs).collect():
        taken[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +taken
    assert corpus_pipeline.quality(spark, no_docs, DATA).count() == corpus_pipeline.mixed(spark, no_docs, DATA).count() == 0
