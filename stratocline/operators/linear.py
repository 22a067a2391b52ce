"""Principal-component regression by month: decomposition, selection of components, station fits, prediction.

A (gcm, var, month) group is a matrix of at most some hundred years by a few hundred
cells, so decomposition is one task per group; ``pca_long`` takes groups of any number of times,
whose products of cells are summed over all tasks.  Stations meet its scores in blocks and leave the sums
of products of their years (moments) by role; every candidate set of components is a small solve on them, so that the
selection is one pass over the moments and a mean per candidate for each round, and the fits are another pass.  Projection onto loadings, moving means, prediction and residuals, whose
length is that of the run, are windows, joins and sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from stratocline.functions import scalars as S
from stratocline.operators.moving import frame, moving_mean
from stratocline.operators.steps import written

# Fixed values of the selection: share of variance that starts the set, size of the pool,
# least share in the pool, needed gain, most rounds, least years to fit and to validate.
START_SHARE, POOL, LEAST_SHARE, GAIN, MAX_ROUNDS, MIN_FIT, MIN_VAL = 0.10, 20, 1e-5, 0.99, 16, 20, 5

STRIP = 64  # rows of a matrix of products that travel together
SHARES = 64  # tasks are dealt to so many shares, whose sums are added first
HELD_BYTES = 64 << 20  # products of all groups that a task holds
_STRIPS = "group string, strip int, share int, gram binary"
_STRIP_SCHEMA = pa.schema([("group", pa.string()), ("strip", pa.int32()), ("share", pa.int32()), ("gram", pa.binary())])


def decompose(x: np.ndarray, centre: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores, loadings, share of variance, mean) of rows by thin SVD; the largest loading of each component is positive."""
    mean = x.mean(0) if centre else np.zeros(x.shape[1])
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    sign[sign == 0] = 1
    var = s**2
    return u * s * sign, vt * sign[:, None], var / var.sum() if var.sum() else var, mean


def ols(x: np.ndarray, y: np.ndarray, intercept: bool = True) -> tuple[np.ndarray, float, float]:
    """(coefficients, root mean square error, residual variance with k degrees of freedom less)."""
    a = np.column_stack([np.ones(len(x)), x]) if intercept else x
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    r = y - a @ beta
    return beta, float(np.sqrt(np.mean(r**2))), float(r @ r / max(len(y) - a.shape[1], 1))


def _matrix(pdf: pd.DataFrame, rows: str) -> pd.DataFrame:
    """Times by cells, of the cells that have a value at every time."""
    return pdf.pivot(index=rows, columns="cell", values="value").sort_index(axis=1).dropna(axis=1) if len(pdf) else pd.DataFrame()


def pca_model(field: DataFrame, keys: list[str], components: int | None = None) -> DataFrame:
    """(keys, pc, share, cell array, mean and loading arrays in its order) of a field (keys, t, cell, value).

    Cells with a gap are left out; fewer than two times or no whole cell give no components.
    """
    types = dict(field.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", pc int, share double, cell array<{types['cell']}>, mean array<double>, loading array<double>"

    def fit(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf, "t")
        if len(x) < 2 or x.shape[1] == 0:
            return pd.DataFrame(columns=[*keys, "pc", "share", "cell", "mean", "loading"])
        _, loadings, share, mean = decompose(x.to_numpy(float))
        n = min(components or len(share), len(share))
        return pd.DataFrame({**{k: [v] * n for k, v in zip(keys, key)}, "pc": range(1, n + 1), "share": share[:n], "cell": [x.columns.to_numpy()] * n, "mean": [mean] * n, "loading": list(loadings[:n])})

    return field.select(*keys, "t", "cell", "value").groupBy(*keys).applyInPandas(fit, schema)


def pca_long(field: DataFrame, keys: list[str], components: int | None = None) -> DataFrame:
    """``pca_model`` of groups of any number of times and up to some thousand cells; t and cell tell a group's rows apart.

    Means first, then each task sums the products of the centred cells of the times that it holds, in strips of
    ``STRIP`` rows; strips are added in two steps, so that no task sees more than a strip from a share of the tasks.  What meets in
    one task is one matrix of cells by cells, whatever the number of times.  Shares below some 1e-12 are rounding.
    """
    types = dict(field.dtypes)
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    named = F.to_json(F.struct(*keys)) if keys else F.lit("")
    field = field.select(*keys, named.alias("group"), "t", "cell", value.alias("value"))
    times = field.select("group", "t").distinct().groupBy(F.col("group").alias("t_group")).agg(F.count(F.lit(1)).alias("times"))
    cells = field.groupBy(*keys, "group", "cell").agg(F.count("value").alias("held"), F.avg("value").alias("mean"))
    whole = cells.join(times, F.col("group") == F.col("t_group")).where((F.col("held") == F.col("times")) & (F.col("times") >= 2))
    whole = written(whole.select(*keys, "group", "cell", "mean", "times"))
    centre = whole.select(F.col("group").alias("w_group"), F.col("cell").alias("w_cell"), "mean")
    rows = field.join(centre, (F.col("group") == F.col("w_group")) & (F.col("cell") == F.col("w_cell")))
    rows = rows.groupBy("group", "t").agg(F.sort_array(F.collect_list(F.struct("cell", (F.col("value") - F.col("mean")).alias("d")))).alias("row"))
    parts = rows.select("group", F.transform("row", lambda c: c["d"]).alias("d")).mapInArrow(_products, _STRIPS)
    for by in (["group", "strip", "share"], ["group", "strip"]):
        parts = parts.groupBy(*by).applyInArrow(_added, _STRIPS)
    frame_ = whole.groupBy(*keys, "group").agg(F.sort_array(F.collect_list(F.struct("cell", "mean"))).alias("cells"), F.first("times").alias("times"))
    frame_ = frame_.select(*keys, F.col("group").alias("f_group"), "times", F.transform("cells", lambda c: c["cell"]).alias("cell"), F.transform("cells", lambda c: c["mean"]).alias("mean"))
    found = parts.groupBy("group").applyInArrow(_axes, "group string, pc int, share double, loading array<double>")
    most = F.least(F.col("times"), F.size("cell"), F.lit(components or 1 << 30))
    return found.join(frame_, F.col("group") == F.col("f_group")).where(F.col("pc") <= most).select(*keys, "pc", "share", F.col("cell").cast(f"array<{types['cell']}>").alias("cell"), "mean", "loading")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of cells of each group in a task, as strips; sent on when they hold ``HELD_BYTES``."""
    share = TaskContext.get().partitionId() % SHARES
    held: dict[str, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for name, gram in held.items():
            for at in range(0, len(gram), STRIP):
                yield pa.RecordBatch.from_pylist([{"group": name, "strip": at // STRIP, "share": share, "gram": gram[at : at + STRIP].tobytes()}], _STRIP_SCHEMA)
        held.clear()

    for b in batches:
        names, lists = np.array(b.column(0).to_pylist(), object), b.column(1)
        for name in dict.fromkeys(names):
            own = lists.filter(pa.array(names == name))
            x = own.flatten().to_numpy().reshape(len(own), -1)
            held[name] = held.get(name, 0.0) + x.T @ x
        if sum(g.nbytes for g in held.values()) > HELD_BYTES:
            yield from sent()
    yield from sent()


def _added(part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(g.as_py()) for g in part.column("gram"))
    one = part.slice(0, 1).to_pylist()[0]
    return pa.Table.from_pylist([{**one, "gram": total.tobytes()}], _STRIP_SCHEMA)


def _axes(strips: pa.Table) -> pa.Table:
    """Components of a group from all its strips, strongest first; the largest loading of each is positive."""
    strips = strips.sort_by("strip")
    gram = np.concatenate([np.frombuffer(g.as_py()) for g in strips.column("gram")])
    size = int(round(len(gram) ** 0.5))
    power, axes = np.linalg.eigh(gram.reshape(size, size))
    power, axes = np.maximum(power[::-1], 0.0), axes.T[::-1]
    sign = np.sign(axes[np.arange(size), np.abs(axes).argmax(1)])
    axes = axes * np.where(sign == 0, 1, sign)[:, None]
    share = power / power.sum() if power.sum() else power
    return pa.table({"group": pa.array([strips.column("group")[0].as_py()] * size, pa.string()), "pc": pa.array(range(1, size + 1), pa.int32()), "share": share, "loading": pa.array(list(axes), pa.list_(pa.float64()))})


def loadings_of(pca: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pc, cell, weight, mean) of the components of ``pca_model``."""
    rows = pca.select(*keys, "pc", F.explode(F.arrays_zip("cell", "loading", "mean")).alias("z"))
    return rows.select(*keys, "pc", "z.cell", F.col("z.loading").alias("weight"), "z.mean")


def project(field: DataFrame, loadings: DataFrame, keys: list[str]) -> DataFrame:
    """Scores (keys, t, pc, score) of a field (keys, t, cell, value) on loadings (keys, pc, cell, mean, weight): a join and a sum."""
    joined = field.join(loadings, [*keys, "cell"])
    return joined.groupBy(*keys, "t", "pc").agg(F.sum((F.col("value") - F.col("mean")) * F.col("weight")).alias("score"))


def simple_ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept per key from sums, in one partial aggregate."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(pair).groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def two_predictor_ols(df: DataFrame, keys: list[str], x1: str, x2: str, y: str) -> DataFrame:
    """Coefficients of two centred predictors by the normal equations, from moments in one partial aggregate."""
    one = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"), F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
    )
    det = F.nullif(F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12"), F.lit(0.0))
    b1 = F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det)
    b2 = F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det)
    return one.withColumn("b1", b1).withColumn("b2", b2).select(*keys, "n", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2")


def _validation_error(scores: np.ndarray, y: np.ndarray, cal: np.ndarray, val: np.ndarray, min_fit: int = MIN_FIT) -> float:
    """The mean over stations of the validation error of fits on the calibration years; stations of one gap pattern share a fit."""
    valid = ~np.isnan(y)
    errors = []
    patterns, which = np.unique(valid.T, axis=0, return_inverse=True)
    for k, pattern in enumerate(patterns):
        fit, test = pattern & cal, pattern & val
        if fit.sum() < min_fit or test.sum() < MIN_VAL:
            continue
        a = np.column_stack([np.ones(len(scores)), scores])
        mine = y[:, which.ravel() == k]
        beta = np.linalg.lstsq(a[fit], mine[fit], rcond=None)[0]
        errors.extend(np.sqrt(((mine[test] - a[test] @ beta) ** 2).mean(0)))
    return float(np.mean(errors)) if errors else np.inf


def select_components(scores: np.ndarray, share: np.ndarray, y: np.ndarray, cal: np.ndarray, val: np.ndarray, error: Callable = _validation_error) -> list[int]:
    """Forward selection: strong components first; then, round by round, the pool is tried in order.

    Within a round each component that beats the best error so far by the needed gain
    becomes the candidate and its error the one to beat; the last candidate joins.
    """
    chosen = [int(i) for i in np.flatnonzero(share > START_SHARE)] or [0]
    rest = [i for i in range(len(share)) if i not in chosen][:POOL]
    pool = [i for i in rest if share[i] >= LEAST_SHARE]
    best = error(scores[:, chosen], y, cal, val)
    for _ in range(MAX_ROUNDS):
        candidate = None
        for i in pool:
            now = error(scores[:, [*chosen, i]], y, cal, val)
            if now < GAIN * best:
                candidate, best = i, now
        if candidate is None:
            break
        chosen.append(candidate)
        pool.remove(candidate)
    return chosen


MODEL = "pc array<int>, beta array<double>, n_fit int, rmse_train double, rmse_val double, rmse_test double, r2_train double, sigma2 double, mu double, offset double, share double"


MOMENTS = "n int, offset double, mu double, held array<int>, sums array<double>"
STATION_BLOCKS = 64  # least number of blocks that the stations of a month are dealt to
BLOCK_VALUES = 8_000  # values of a block, about
SLICE = 256  # stations whose moments are arrays at a time
ROLES = ("cal", "val", "test")


def moments(obs: DataFrame, scores: DataFrame, roles: dict[str, list[int]], keys: list[str], *, log: bool = False, min_years: int = 30) -> DataFrame:
    """(keys, id, n, offset, mu, held, sums) of obs (keys, id, year, value) and scores (keys, year, scores array).

    Per role of ``ROLES`` the number of years held, and of its rows (1, scores, linked value less mu) the sums of products, a
    matrix.  Years are those that scores have and any station of the month reports; stations with too few of them are left out.
    """
    types = dict(obs.dtypes)
    role_years = {role: set(roles.get(role, ())) for role in ROLES}
    known = obs.where(F.col("value").isNotNull()).groupBy(*keys, "id", "year").agg(F.first("value").alias("value"))
    known = written(known.join(scores.select(*keys, "year"), [*keys, "year"], "left_semi"))
    span = known.groupBy(*keys).agg(F.count_distinct("year").alias("years"), F.count(F.lit(1)).alias("__n")).where(F.col("years") >= min_years)
    # blocks of one size however many stations a month has
    blocks = F.greatest(F.lit(STATION_BLOCKS), F.ceil(F.col("__n") / BLOCK_VALUES))
    rows = known.join(span, keys).withColumn("__block", F.pmod(F.xxhash64("id"), blocks)).drop("__n")
    by = [*keys, "__block"]
    beside = scores.join(rows.select(*by).distinct(), keys).select(*[F.col(c).alias(f"s_{c}") for c in by], "year", "scores")

    def build(key: tuple[Any, ...], own: pd.DataFrame, net: pd.DataFrame) -> pd.DataFrame:
        x = {int(y): np.concatenate([[1.0], s]) for y, s in zip(net["year"], net["scores"])}
        out = []
        for name, rows_ in own.groupby("id", sort=True):
            years, v = rows_["year"].to_numpy(), rows_["value"].to_numpy(float)
            if len(v) < max(min(10, min_years), int(0.15 * rows_["years"].iloc[0])):
                continue
            offset = 1 + v.min() if log else None
            linked = np.log(v + offset) if log else v
            mu = linked.mean()
            a = np.column_stack([np.array([x[int(y)] for y in years]), linked - mu])
            part = [a[[int(y) in role_years[role] for y in years]] for role in ROLES]
            out.append([*key[: len(keys)], name, len(v), offset, mu, [len(p) for p in part], np.concatenate([(p.T @ p).ravel() for p in part])])
        return pd.DataFrame(out, columns=[*keys, "id", *[c.split()[0] for c in MOMENTS.split(", ")]])

    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "id"]) + f", {MOMENTS}"
    tasks, other = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), [f"s_{c}" for c in by]
    return rows.repartition(tasks, *by).groupBy(*by).cogroup(beside.repartition(tasks, *other).groupBy(*other)).applyInPandas(build, schema)


def _slices(batches: Iterator[pa.RecordBatch], keys: list[str], min_fit: int) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(key, rows, numbers of years (stations, roles), moments (stations, roles, size, size)) of ``SLICE`` stations or fewer of one key, with ``min_fit`` years to fit."""
    for batch in batches:
        names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        for key in dict.fromkeys(names):
            own = np.flatnonzero([n == key for n in names])
            for at in range(0, len(own), SLICE):
                part = batch.take(pa.array(own[at : at + SLICE]))
                n = part.column("held").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                some = np.flatnonzero(n[:, 0] >= min_fit)
                if len(some):
                    m = part.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                    size = int(round((m.shape[1] / n.shape[1]) ** 0.5))
                    yield key, part.take(pa.array(some)), n[some], m[some].reshape(len(some), n.shape[1], size, size)


def _solved(n: np.ndarray, m: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of the fits on the first role, mean squared errors (stations, roles)) from moments; NaN for a role without years."""
    at = np.array([0, *[c + 1 for c in chosen]])
    a, b = m[:, 0][:, at[:, None], at], m[:, 0][:, at, -1]
    scale = np.sqrt(np.maximum(np.einsum("sii->si", a), 1e-300))
    a, b = a / (scale[:, :, None] * scale[:, None]), b / scale
    try:
        beta = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        if not np.isfinite(beta).all() or np.abs(beta).max(initial=0.0) > 1e8:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:  # components that are constant over a station's years
        beta = (np.linalg.pinv(a, hermitian=True) @ b[:, :, None])[:, :, 0]
    beta = beta / scale
    left = m[:, :, -1, -1] - 2 * np.einsum("si,sri->sr", beta, m[:, :, at, -1]) + np.einsum("si,srij,sj->sr", beta, m[:, :, at[:, None], at], beta)
    return beta, np.where(n > 0, np.maximum(left, 0.0) / np.maximum(n, 1), np.nan)


def candidate_errors(found: DataFrame, tried: dict[tuple, list[list[int]]], keys: list[str], min_fit: int) -> dict[tuple, list[float]]:
    """The mean validation error over stations of each candidate set, for every key: one pass over the moments, partial sums by task."""
    names = [*keys, "candidate", "total", "n"]

    def errors(batches):
        sums: dict[tuple, list[float]] = {}
        for key, _, n, m in _slices(batches, keys, min_fit):
            some = n[:, 1] >= MIN_VAL
            if some.any() and key in tried:
                for c, chosen in enumerate(tried[key]):
                    one = sums.setdefault((*key, c), [0.0, 0])
                    one[0] += float(np.sqrt(_solved(n[some], m[some], chosen)[1][:, 1]).sum())
                    one[1] += int(some.sum())
        yield pa.RecordBatch.from_pandas(pd.DataFrame([[*k, *v] for k, v in sums.items()], columns=names), arrow, preserve_index=False)

    schema = StructType([*[found.schema[k] for k in keys], StructField("candidate", IntegerType()), StructField("total", DoubleType()), StructField("n", LongType())])
    arrow = to_arrow_schema(schema)
    made = found.select(*keys, "held", "sums").mapInArrow(errors, schema)
    out = {key: [np.inf] * len(sets) for key, sets in tried.items()}
    for r in made.groupBy(*keys, "candidate").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[tuple(r[k] for k in keys)][r["candidate"]] = r["total"] / r["n"]
    return out


def select_from_moments(found: DataFrame, shares: dict[tuple, np.ndarray], keys: list[str], min_fit: int = MIN_FIT) -> dict[tuple, list[int]]:
    """The choice of ``select_components`` for every key, from moments: keys advance together, a pass for each round."""
    chosen = {k: [int(i) for i in np.flatnonzero(share > START_SHARE)] or [0] for k, share in shares.items()}
    pool = {k: [i for i in [i for i in range(len(share)) if i not in chosen[k]][:POOL] if share[i] >= LEAST_SHARE] for k, share in shares.items()}
    best = {k: e[0] for k, e in candidate_errors(found, {k: [c] for k, c in chosen.items()}, keys, min_fit).items()}
    open_ = set(chosen)
    for _ in range(MAX_ROUNDS):
        tried = {k: [[*chosen[k], i] for i in pool[k]] for k in open_ if pool[k]}
        if not tried:
            break
        for k, now in candidate_errors(found, tried, keys, min_fit).items():
            candidate = None
            for i, e in zip(pool[k], now):
                if e < GAIN * best[k]:
                    candidate, best[k] = i, e
            if candidate is None:
                open_.discard(k)
            else:
                chosen[k].append(candidate)
                pool[k].remove(candidate)
        open_ &= set(tried)
    return chosen


def calibrate(obs: DataFrame, field: DataFrame, roles: dict[str, list[int]], keys: list[str] = ["month"], *, log: bool = False, min_years: int = 30, min_fit: int = MIN_FIT, pca: DataFrame | None = None) -> DataFrame:
    """Station models (keys, id, chosen components, coefficients, errors).

    obs: (keys, id, year, value); field: (keys, year, cell, value) of the whole calibration
    period, which ``pca_model`` decomposes (or has decomposed: ``pca``).  With ``log`` a station's values go
    through ln(value + offset), offset = 1 + least value, else offset is null.  ``mu`` is the
    station's mean after the link, errors are those of the linked values, sigma2 is the mean
    squared residual of the fit, share the variance that the chosen components hold.
    Months with fewer than ``min_years`` common years give no models; stations with fewer
    than ``min_fit`` calibration values give none either.
    """
    columns = [*keys, "id", *[c.split()[0] for c in MODEL.split(", ")]]
    timed = field.withColumnRenamed("year", "t")
    # the starting components have shares above a tenth, so there are fewer than ten; the pool follows them
    pca = written((pca_model(timed, keys) if pca is None else pca).where(F.col("pc") <= POOL + int(1 / START_SHARE)))
    shares: dict[tuple, np.ndarray] = {}
    for r in pca.select(*keys, "pc", "share").orderBy("pc").collect():  # at most thirty for each key
        shares.setdefault(tuple(r[k] for k in keys), []).append(r["share"])
    wide = written(project(timed, loadings_of(pca, keys), keys).groupBy(*keys, F.col("t").alias("year")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "score"))), lambda z: z["score"]).alias("scores")))
    # rows are few and the work on them long: as many files as tasks
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(moments(obs, wide, roles, keys, log=log, min_years=min_years).repartition(tasks, *keys, "id"))
    present = {tuple(r) for r in found.select(*keys).distinct().collect()}
    share_of = {k: np.array(v) for k, v in shares.items() if k in present}
    chosen = select_from_moments(found, share_of, keys, min_fit)

    def fit(batches):
        for key, own, n, m in _slices(batches, keys, min_fit):
            rows = []
            betas, errors_ = _solved(n, m, chosen[key])
            spread = m[:, 0, -1, -1] / n[:, 0] - (m[:, 0, 0, -1] / n[:, 0]) ** 2
            ids, mus, offsets = (own.column(c).to_pylist() for c in ("id", "mu", "offset"))
            for name, mu, offset, years, beta, (error, late, last), v in zip(ids, mus, offsets, n[:, 0], betas, errors_, spread):
                ends = [None if np.isnan(e) else float(e**0.5) for e in (late, last)]
                rows.append([*key, name, [c + 1 for c in chosen[key]], beta.tolist(), int(years), float(error**0.5), *ends, float(1 - error / v) if v > 0 else None, float(error), mu, offset if log else None, float(share_of[key][chosen[key]].sum())])
            yield pa.RecordBatch.from_pylist([dict(zip(columns, row)) for row in rows], arrow)

    schema = StructType([*[found.schema[k] for k in [*keys, "id"]], *StructType.fromDDL(MODEL).fields])
    arrow = to_arrow_schema(schema)
    return found.mapInArrow(fit, schema)


def fallback_roles(years: list[int], n_val: int = 50, n_test: int = 15, seed: int = 2026) -> dict[str, list[int]]:
    """A seeded split of the years at hand: at most half of them validate, at most a third of the rest test."""
    years = sorted(years)
    n_val = min(n_val, len(years) // 2)
    n_test = min(n_test, (len(years) - n_val) // 3)
    order = np.random.default_rng(seed).permutation(len(years))
    parts = {"val": order[:n_val], "test": order[n_val : n_val + n_test], "cal": order[n_val + n_test :]}
    return {role: sorted(int(years[i]) for i in at) for role, at in parts.items()}


def _vectors(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, scores): the scores (keys, t, pc, score) of a time as a map from components."""
    return scores.groupBy(*keys, "t").agg(F.map_from_entries(F.collect_list(F.struct("pc", "score"))).alias("scores"))


def _with_fit(met: DataFrame) -> DataFrame:
    """Adds the fit, intercept and chosen components, of a model (pc, beta) beside the scores of a time, of which it needs one component at least."""
    terms = F.transform("pc", lambda c, i: F.struct(c.alias("pc"), F.get(F.col("beta"), i + 1).alias("w")))
    held = F.filter(terms, lambda z: (F.col("scores")[z["pc"]] * z["w"]).isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda a, z: a + F.col("scores")[z["pc"]] * z["w"])
    some = met.where(F.exists("pc", lambda c: F.map_contains_key(F.col("scores"), c)))
    return some.withColumn("fit", F.when(F.size(held) > 0, F.col("beta")[0] + total))


def fitted(scores: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, t, fit): intercept and chosen components of scores (keys, t, pc, score), a row per station and time from the join on."""
    met = models.select(*keys, "id", "pc", "beta").join(_vectors(scores, keys), keys)
    return _with_fit(met).select(*keys, "id", "t", "fit")


def _unlinked(models: DataFrame, g: Column) -> Column:
    """``g`` itself, or back through the log link, with the half variance that keeps the mean and not below zero, where the model has an offset."""
    back = S.clip_zero(S.inverse_log_link(g + F.coalesce("sigma2", F.lit(0.0)) / 2, F.col("offset")))
    return F.when(F.col("offset").isNull(), g).otherwise(back) if "offset" in models.columns else g


def predict(scores: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, t, value) of scores (keys, t, pc, score) within the calibration climate."""
    rest = models.select(*keys, "id", "pc", "beta", "mu", *[c for c in ("sigma2", "offset") if c in models.columns])
    out = _with_fit(rest.join(_vectors(scores, keys), keys))
    return out.select(*keys, "id", "t", _unlinked(models, F.col("fit") + F.col("mu")).alias("value"))


def moving_change(field: DataFrame, keys: list[str], calibration: Column, k: int = 30, *, log: bool = False) -> DataFrame:
    """(keys, t, cell, value, shift): the field less its moving mean, and the moving mean less the calibration mean.

    With ``log`` both means are of ln(value + 1 + least calibration value of the cell), and
    the field loses that mean, as the published method has it.  ``calibration`` is a
    condition on the rows; a cell without calibration rows has a null shift.  One
    partitioning and one sort, frames of ``k`` rows.
    """
    whole, v = Window.partitionBy(*keys, "cell"), F.col("value")
    linked = F.ln(v + 1 + F.min(F.when(calibration, v)).over(whole)) if log else v
    moved = field.withColumn("__g", linked).withColumn("__m", moving_mean(F.col("__g"), frame([*keys, "cell"], ["t"], k)))
    base = F.avg(F.when(calibration, F.col("__g"))).over(whole)
    return moved.select(*keys, "t", "cell", (v - F.col("__m")).alias("value"), (F.col("__m") - base).alias("shift"))


def predict_transient(field: DataFrame, loadings: DataFrame, models: DataFrame, places: DataFrame, keys: list[str], calibration: Column, k: int = 30, *, log: bool = False) -> DataFrame:
    """(keys, id, t, value) of a whole run (keys, t, cell, value), with the model's own slow change added.

    Scores are those of the field less its moving mean; each station gets the shift of the
    cell that ``places`` (id, cell) names.  A time at which that cell has no shift gives
    null.  Shifts are kept only for cells with stations, before they meet the predictions.
    """
    moved = moving_change(field, keys, calibration, k, log=log)
    scores = project(moved, loadings.withColumn("mean", F.lit(0.0)), keys)
    rest = models.select(*keys, "id", "pc", "beta", "mu", *[c for c in ("sigma2", "offset") if c in models.columns])
    # shifts are few and meet stations by cells; nothing of a station and a time is shuffled if they are broadcast
    near = rest.join(places.select("id", "cell"), "id", "left").join(_vectors(scores, keys), keys)
    out = _with_fit(near.join(moved.select(*keys, "t", "cell", "shift"), [*keys, "t", "cell"], "left"))
    return out.select(*keys, "id", "t", _unlinked(models, F.col("fit") + F.col("mu") + F.col("shift")).alias("value"))


def residuals(obs: DataFrame, scores: DataFrame, models: DataFrame, keys: list[str], years: list[int], least: int = MIN_FIT) -> DataFrame:
    """(keys, id, t, value): linked observations of ``years`` less what the stored models fit; stations with ``least`` or more."""
    rows = obs.where(F.col("year").isin(*years) & F.col("value").isNotNull()).select(*keys, "id", F.col("year").alias("t"), F.col("value").alias("o"))
    joined = rows.join(models.select(*keys, "id", "mu", "offset"), [*keys, "id"]).join(fitted(scores, models, keys), [*keys, "id", "t"])
    linked = F.when(F.col("offset").isNull(), F.col("o")).otherwise(S.log_link(F.col("o"), F.col("offset")))
    out = joined.select(*keys, "id", "t", (linked - F.col("mu") - F.col("fit")).alias("value"))
    return out.withColumn("__n", F.count("value").over(Window.partitionBy(*keys, "id"))).where(F.col("__n") >= least).drop("__n")


def diagnostics(models: DataFrame, keys: list[str] = ["month"]) -> DataFrame:
    """One row per month: stations, components, their share in percent, medians of errors and of R2."""
    median = [F.median(c).alias(c) for c in ("rmse_train", "rmse_test", "r2_train")]
    return models.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stations"), F.max(F.size("pc")).alias("n_pc"), (100 * F.max("share")).alias("ev_pct"), *median)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _hashed(h: np.ndarray, v: int | np.ndarray) -> np.ndarray:
    """xxhash64 of 32-bit whole numbers, not negative, with the seeds ``h``: what ``F.xxhash64`` does for each further int column."""
    h = (h + np.uint64(0x27D4EB2F165667C5 + 4)) ^ (np.asarray(v, np.uint64) * np.uint64(0x9E3779B185EBCA87))
    return _mixed(((h << np.uint64(23)) | (h >> np.uint64(41))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def monte_carlo_interval(df: DataFrame, keys: list[str], mse: Column, draws: int = 1000, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 % quantiles of value + N(0, mse) over ``draws`` seeded draws, made and ranked in arrays of some rows.

    A draw hangs on the keys, its number and the seed alone, not on partitions: it takes the two hashes ``xxhash64(keys, number, seed, 1 or 2)``.
    """
    types = dict(df.dtypes)
    ranks = [divmod(p * (draws - 1), 1) for p in (0.025, 0.975)]
    wanted = sorted({min(int(low) + i, draws - 1) for low, _ in ranks for i in (0, 1)})

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(1, draws + 1, dtype=np.uint64)
        rows = max(1, 65_536 // draws)  # arrays that stay in a core's cache
        for batch in batches:
            start = batch.column("__h").to_numpy(zero_copy_only=False).view(np.uint64)
            found = np.empty((len(wanted), len(start)))
            for at in range(0, len(start), rows):
                h = _hashed(_hashed(start[at : at + rows, None], number), seed)
                u, v = (((_hashed(h, i) & np.uint64((1 << 52) - 1)).astype(float) + 0.5) / float(1 << 52) for i in (1, 2))
                z = np.partition(np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v), wanted, axis=1)
                found[:, at : at + rows] = z[:, wanted].T
            quantiles = []
            for low, part in ranks:
                a, b = (found[wanted.index(min(int(low) + i, draws - 1))] for i in (0, 1))
                quantiles.append(pa.array(a + (b - a) * part))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keys, "value", "mse"]], *quantiles], names=[*keys, "value", "mse", "lo", "hi"])

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", value {types['value']}, mse double, lo double, hi double"
    # rows are small and the work on them long: as many tasks as the session has partitions
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys, "value", mse.cast("double").alias("mse"), F.xxhash64(*keys).alias("__h")).repartition(tasks, *keys).mapInArrow(drawn, schema)
    return rows.select(*keys, "value", *[(F.col("value") + F.sqrt("mse") * F.col(c)).alias(f"pi_{c}") for c in ("lo", "hi")])
