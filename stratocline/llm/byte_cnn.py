"""A byte-level convolutional quality classifier in numpy.

Shape of the network: bytes are embedded; learned filters of ``KERNEL`` bytes slide
over the whole text in steps of ``STRIDE``; each filter is max-pooled over
overlapping chunks of two segments of ``SEGMENT`` bytes; a small hidden layer reads
each chunk; its maximum and mean over all chunks are combined into one probability.
Nothing but the bytes of the text enters a score.

Fitting runs on the driver over a bounded sample of labelled rows: per class at
most ``per_class`` ids (of the smallest hashes), one text each (the smallest), of at most
``max_fit_bytes`` bytes.  Scoring runs over all rows inside the tasks, in slices of
a fixed number of segments, so that memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocline.llm.common import table
from stratocline.llm.hashing import slices

SEGMENT, KERNEL, STRIDE, EMBED, FILTERS, HIDDEN = 128, 6, 2, 6, 24, 12
SLICE = 512  # segments that are convolved at once
PER_CLASS, MAX_FIT_BYTES, EPOCHS, BATCH, SEED = 900, 32_768, 8, 24, 7

THRESHOLD = 0.5  # below which a document is rejected

Model = dict[str, np.ndarray]


def new_model(seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    shape = {"E": (256, EMBED), "K": (KERNEL * EMBED, FILTERS), "c": (FILTERS,), "W": (FILTERS, HIDDEN), "d": (HIDDEN,), "w": (2 * HIDDEN,), "b": (1,)}
    scale = {"E": 0.5, "K": (2 / (KERNEL * EMBED)) ** 0.5, "W": (2 / FILTERS) ** 0.5, "w": 0.3}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in shape.items()}


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one zero-padded buffer, and the first segment of each, with the total at the end."""
    counts = [max(1, -(-(len(t) + KERNEL) // SEGMENT)) for t in texts]
    starts = np.concatenate([[0], np.cumsum(counts)])
    buf = bytearray(int(starts[-1]) * SEGMENT + KERNEL)
    for t, s in zip(texts, starts):
        buf[s * SEGMENT : s * SEGMENT + len(t)] = t
    return np.frombuffer(bytes(buf), np.uint8), starts


def windows(m: Model, buf: np.ndarray) -> np.ndarray:
    x = m["E"][buf]
    n = (len(buf) - KERNEL) // STRIDE
    step = x.strides[0]
    return np.lib.stride_tricks.as_strided(x, (n, KERNEL * EMBED), (STRIDE * step, x.strides[1])).copy()


def pooled(m: Model, buf: np.ndarray) -> np.ndarray:
    """Each filter's maximum over each segment."""
    total = (len(buf) - KERNEL) // SEGMENT
    out = np.empty((total, FILTERS), np.float32)
    for s in range(0, total, SLICE):
        e = min(total, s + SLICE)
        y = windows(m, buf[s * SEGMENT : e * SEGMENT + KERNEL]) @ m["K"]
        out[s:e] = y.reshape(e - s, SEGMENT // STRIDE, FILTERS).max(1)
    return np.maximum(out + m["c"], 0)


def chunks(seg: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima over overlapping chunks (each segment with the next one of its text), and the segment after."""
    after = np.arange(1, len(seg) + 1)
    after[starts[1:] - 1] -= 1  # the last segment of a text stands alone
    return np.maximum(seg, seg[after]), after


def forward(m: Model, seg: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    z, after = chunks(seg, starts)
    h = np.maximum(z @ m["W"] + m["d"], 0)
    most = np.maximum.reduceat(h, starts[:-1])
    count = np.diff(starts)[:, None]
    mean = (np.add.reduceat(h.astype(np.float64), starts[:-1]) / count).astype(np.float32)
    logit = np.concatenate([most, mean], 1) @ m["w"] + m["b"][0]
    p = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -60, 60)))
    return p, {"z": z, "after": after, "h": h, "most": most, "mean": mean, "count": count}


def gradients(m: Model, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> Model:
    buf, starts = segments(texts)
    n_seg, per = int(starts[-1]), SEGMENT // STRIDE
    win = windows(m, buf)
    conv = (win @ m["K"]).reshape(n_seg, per, FILTERS)
    where = conv.argmax(1)
    raw = np.take_along_axis(conv, where[:, None], 1)[:, 0] + m["c"]
    seg = np.maximum(raw, 0)
    p, t = forward(m, seg, starts)
    g = ((p - y) * weight / len(y)).astype(np.float32)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    out = {"w": np.concatenate([t["most"], t["mean"]], 1).T @ g, "b": np.array([g.sum()], np.float32)}
    top = (t["h"] == t["most"][doc]).astype(np.float32)
    top /= np.maximum(np.add.reduceat(top, starts[:-1])[doc], 1)
    gh = g[doc, None] * (top * m["w"][:HIDDEN] + m["w"][HIDDEN:] / t["count"][doc]) * (t["h"] > 0)
    out["W"], out["d"] = t["z"].T @ gh, gh.sum(0)
    gz = gh @ m["W"].T
    own = seg >= seg[t["after"]]
    gs = gz * own
    np.add.at(gs, t["after"], gz * ~own)
    gs *= raw > 0
    out["c"] = gs.sum(0)
    at = where + (np.arange(n_seg) * per)[:, None]
    out["K"] = np.stack([gs[:, f] @ win[at[:, f]] for f in range(FILTERS)], 1)
    ge = np.zeros_like(m["E"])
    for f in range(FILTERS):
        live = np.flatnonzero(gs[:, f])
        first = at[live, f] * STRIDE
        for k in range(KERNEL):
            np.add.at(ge, buf[first + k], gs[live, f, None] * m["K"][k * EMBED : (k + 1) * EMBED, f])
    out["E"] = ge
    return out


def fit(rows: list[tuple[bytes, int]], *, epochs: int = EPOCHS, batch: int = BATCH, seed: int = SEED, rate: float = 0.01) -> Model | None:
    """Adam on the log loss, both classes weighing the same; None where a class is missing."""
    y_all = np.array([y for _, y in rows], np.float32)
    if not 0 < y_all.sum() < len(rows):
        return None
    m, rng = new_model(seed), np.random.default_rng(seed)
    share = y_all.mean()
    weight = np.where(y_all == 1, 0.5 / share, 0.5 / (1 - share))
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    steps = epochs * -(-len(rows) // batch)
    if steps < 400:  # few rows: more rounds
        epochs = -(-400 * batch // len(rows))
        steps = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            g = gradients(m, [rows[i][0] for i in pick], y_all[pick], weight[pick])
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in m:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                m[k] = (m[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return m


def score_texts(m: Model | None, texts: list[str | None]) -> np.ndarray:
    """One probability per text; without a model 0.5."""
    out = np.full(len(texts), 0.5)
    if m is None:
        return out
    start = 0
    while start < len(texts):
        group, size = [], 0
        while start + len(group) < len(texts) and (not group or size < SLICE * SEGMENT):
            group.append((texts[start + len(group)] or "").encode("utf-8", "replace"))
            size += len(group[-1])
        buf, starts = segments(group)
        out[start : start + len(group)] = forward(m, pooled(m, buf), starts)[0]
        start += len(group)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_fit_bytes: int = MAX_FIT_BYTES, **options) -> Model | None:
    """Fit on labelled rows outside the held-out fold; rows with a null id, label or text are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = None
    for label in (0, 1):
        one = usable.where(F.col("quality") == label).select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("y")).distinct().orderBy(F.xxhash64("l_id"), "l_id").limit(per_class)
        sample = one if sample is None else sample.unionByName(one)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_fit_bytes)
    # at most 2 * per_class ids: a proven bound for the broadcast, and one text of each for what is collected
    one = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = one.orderBy(*order, "y").select("text", "y").collect()
    return fit([(r.text.encode("utf-8", "replace"), r.y) for r in rows], **options)


def score(docs: DataFrame, model: Model | None, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``; null and empty texts are scored as empty."""

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0)
            yield pa.array(np.concatenate([np.empty(0), *[score_texts(model, x.column(0).to_pylist()) for x in parts]]))

    return docs.withColumn(name, probability(F.col(text_col)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids are scored and never held out; repeated rows are scored each; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
