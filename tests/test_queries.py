import math

import duckdb
import pytest

import __spark_entry__ as entry
from stratocline.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("lineitem", "orders", "supplier", "events", "embeddings", "customer", "part", "nation", "region"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.6f}"  # zero has no sign
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)

    def ordered(rows):
        # what is not a double tells rows apart first
        return sorted(([tuple(r), tuple(plain(v) for v in r)] for r in rows), key=lambda r: ([p for v, p in zip(*r) if not isinstance(v, float)], r[1]))

    got, rows = ordered(df.select(*names).collect()), ordered(want.fetchall())
    assert len(got) == len(rows)
    odd = [(x[0], y[0]) for x, y in zip(got, rows) if x[1] != y[1]]
    assert not odd, odd[:5]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_fitting_queries_run(spark, name):
    """Rows come, no row stands twice, and numbers are finite where they are not null."""
    rows = [tuple(r) for r in QUERIES[name](spark, DATA.replace("0.001", "0.01")).collect()]
    assert rows and len({repr(r) for r in rows}) == len(rows)
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_weights_reach_as_far_as_their_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW supplier AS SELECT * FROM '/root/testdata/sf0.01/supplier.parquet'")
    want = {(i, j): w for i, j, w in c.execute(f"SELECT i, j, w FROM ({ORACLE_SQL['q_gauss_weights']})").fetchall()}
    got = {(r.i, r.j): r.w for r in QUERIES["q_gauss_weights"](spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
