"""Stored models in buckets, and archives that are read in a box."""

import pytest
from pyspark.sql import functions as F

from stratocline.sources import archive
from stratocline.sources.model_tables import ModelStore


def table(spark, shift=0, n=200):
    return spark.range(n).select((F.col("id") % 12).cast("int").alias("month"), F.col("id"), (F.col("id") / 4 + shift).alias("mu"), F.array(F.lit(1), F.lit(2)).alias("pc"))


def test_versions_are_replaced_alone(spark, tmp_path):
    store = ModelStore(spark, "versions_of_models", f"file://{tmp_path}/store", buckets=4)
    with pytest.raises(ValueError, match="no version a"):
        store.read("a")
    store.save(table(spark), "a", {"run": "1"})
    store.save(table(spark, 1), "b", {"run": "2"})
    store.save(table(spark, 5, 50), "b", {"run": "3"})
    assert sorted(map(tuple, store.read("a").select("month", "id", "mu").collect())) == sorted(map(tuple, table(spark).select("month", "id", "mu").collect()))
    assert sorted(r["mu"] for r in store.read("b").collect()) == [i / 4 + 5 for i in range(50)]
    assert {(r["version"], r["rows"], r["inputs"]) for r in store.manifest().collect()} == {("a", 200, '{"run": "1"}'), ("b", 50, '{"run": "3"}')}
    with pytest.raises(ValueError, match="columns differ"):
        store.save(table(spark).drop("mu"), "c", {})
    with pytest.raises(ValueError, match="no version c"):
        store.read("c")
    with pytest.raises(ValueError, match="letters"):
        store.save(table(spark), "a' OR '1", {})
    store.save(table(spark).where("id < 0"), "none", {})
    assert store.read("none").count() == 0

    # another session's catalog knows nothing of the table
    other = ModelStore(spark, "versions_of_models_again", store.folder)
    assert other.read("a").count() == 200 and other.read("a").columns == ["month", "id", "mu", "pc"]


def test_join_does_not_shuffle_the_models(spark, tmp_path):
    for name in ("buckets_of_models", "buckets_of_models_again"):
        store = ModelStore(spark, name, f"file://{tmp_path}/store", buckets=4)
        if name == "buckets_of_models":
            store.save(table(spark), "a", {})
        rows = spark.range(1000).select((F.col("id") % 12).cast("int").alias("month"), F.col("id") % 200 + 0 * F.rand(1).cast("long")).toDF("month", "id")
        joined = rows.hint("merge").join(store.read("a"), ["month", "id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan, plan
        assert joined.count() == rows.alias("r").join(table(spark), ["month", "id"]).count() > 0


def lines(name, lat, lon, months, raw=300):
    return "".join(f'{name},"{name}, at sea",{lat},{lon},12.5,{m},{raw},,,,G\n' for m in months)


def test_files_out_of_the_box_are_left_after_a_record(spark, tmp_path):
    months = [199001, 199012, 199106, 199201]
    (tmp_path / "in.csv").write_text(lines("in", 40.0, -100.0, months))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "edge.csv").write_text(lines("edge", 30.0, -80.0, months, -5))
    # what follows the first record cannot be read, and need not be
    (tmp_path / "north.csv").write_text(lines("north", 80.0, -100.0, months[:1]) + "x" * 5000 + "\nno,record\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "short.csv").write_text(lines("short", 35.0, -90.0, months[:1]).strip())
    got = archive.load_archive(spark, str(tmp_path), (30.0, 60.0), (-120.0, -80.0), 1990, 1991).collect()
    assert sorted((r["id"], r["year"] * 100 + r["month"], r["value"] and round(r["value"], 6)) for r in got) == [
        ("edge", 199001, None), ("edge", 199012, None), ("edge", 199106, None),
        ("in", 199001, round(30 / 31, 6)), ("in", 199012, round(30 / 31, 6)), ("in", 199106, 1.0), ("short", 199001, round(30 / 31, 6)),
    ]
    with pytest.raises(Exception, match="(?i)csv|column|expected"):
        archive.load_archive(spark, str(tmp_path), (30.0, 90.0), (-120.0, -80.0), 1990, 1991).collect()


def test_filters_are_pushed(spark, tmp_path):
    (tmp_path / "in.csv").write_text(lines("in", 40.0, -100.0, [199001, 199002]))
    (tmp_path / "north.csv").write_text(lines("north", 80.0, -100.0, [199001]) + "x" * 5000 + "\nno,record\n")
    spark.dataSource.register(archive.StationArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("station_csv").option("pushdown", "true").load(str(tmp_path)).where("lat <= 60 AND yyyymm = 199002 AND name IS NOT NULL")
        assert [(r["id"], r["name"], r["yyyymm"]) for r in rows.collect()] == [("in", "in, at sea", 199002)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_are_shared_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "TASK_BYTES", 1000)
    for i in range(10):
        (tmp_path / f"{i}.csv").write_text("x" * 400)
    (tmp_path / "large.csv").write_text("x" * 5000)
    parts = archive.StationReader({"path": f"file://{tmp_path}"}).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 2, 2, 2, 1]
