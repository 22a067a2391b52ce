"""Two versions of a table: rows of one side, odd values, groups."""

import numpy as np

from stratocline.operators import comparison

ROWS = "id string, year int, value double"


def test_odd_values_differ(spark):
    nan = float("nan")
    a = spark.createDataFrame([("a", 1990, 1.0), ("a", 1991, None), ("a", 1999, nan), ("b", 2000, 1000.0), ("c", 1, 5.0), (None, 1, 1.0)], ROWS)
    b = spark.createDataFrame([("a", 1990, 1.004), ("a", 1991, 1.0), ("a", 1999, nan), ("b", 2000, 1000.014), ("b", 2001, 0.0), (None, 1, 1.0)], ROWS)
    rows = comparison.compared(a, b, ["id", "year"], 0.005)
    got = {(r["id"], r["year"]): (r["found"], r["differs"], r["gap"] is None) for r in rows.collect() if r["id"]}
    assert got == {("a", 1990): ("both", False, False), ("a", 1991): ("both", True, True), ("a", 1999): ("both", True, True), ("b", 2000): ("both", False, False), ("b", 2001): ("right_only", None, True), ("c", 1): ("left_only", None, True)}
    # without the relative part the large value differs
    assert {r["year"] for r in comparison.compared(a, b, ["id", "year"], 0.005, 0.0).where("differs AND id = 'b'").collect()} == {2000}
    # null keys equal none: a row of each side
    assert rows.where("id IS NULL").count() == 2
    by = {r["id"]: (r["matched"], r["total"], r["n_diff"]) for r in comparison.differences_by(rows, ["id"]).collect()}
    assert by == {"a": (3, 3, 2), "b": (1, 2, 0), "c": (0, 1, 0), None: (0, 2, 0)}
    assert {(r["decade"], r["n_diff"]) for r in comparison.differences_by_decade(rows).collect()} == {(1990, 2)}
    assert tuple(comparison.spread(comparison.differences_by(rows, ["id"])).first()) == (4, 3, 1, 1)


def test_parity_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 3, 400))
    a, b = (spark.createDataFrame([(f"k{k}", t, float(v[k, t])) for k in range(3) for t in range(400)], ROWS) for v in (x, y))
    gap = np.abs(x - y)
    for r in comparison.parity(comparison.compared(a, b, ["id", "year"], 0.0), ["id"], {"over": 1.0}).collect():
        g = gap[int(r["id"][1])]
        assert r["n"] == 400 and r["largest"] == g.max() and abs(r["mean"] - g.mean()) < 1e-8 and abs(r["median"] - np.median(g)) < 1e-12 and r["over"] == (g > 1).mean()
    assert comparison.parity(comparison.compared(a.limit(0), b, ["id", "year"], 0.0), ["id"], {"over": 1.0}).count() == 0
