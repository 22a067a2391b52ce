import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocline.operators import grids, selection
from stratocline.sources import fields, stations
from stratocline.streaming.tumbling import tumbling_means


def line(name, year, values):
    return f"{name:<11}{year}TAVG" + "".join(f"{v:5d}   " for v in values)


def test_fixed_width_lines(spark, tmp_path):
    (tmp_path / "x.dat").write_text(line("BB000078954", 1943, [-9999] * 9 + [2642, 2562, 2479]) + "\n" + line("BB000078954", 1944, [100] * 11)[:19] + "\n")
    (tmp_path / "x.inv").write_text("BB000078954  13.0700  -59.4800   50.0 SOMEWHERE\n")
    rows = {(r.year, r.month): r.value for r in stations.read_observations(spark, str(tmp_path / "x.dat")).collect()}
    assert [rows[1943, m] for m in (9, 10, 11, 12)] == [None, 26.42, 25.62, 24.79]
    assert all(rows[1944, m] is None for m in range(1, 13))
    got = stations.load_temperature(spark, str(tmp_path / "x.dat"), str(tmp_path / "x.inv")).collect()
    assert len(got) == 3 and {(r.lat, r.lon, r.elev) for r in got} == {(13.07, -59.48, 50.0)}


def test_precipitation_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A1,"NAME, X", 40.0,-100.0,10.0,199602, 290, , ,S,1\nA1,"NAME, X",40.0,-100.0,10.0,199603,-1, , ,S,1\n')
    (tmp_path / "b.csv").write_text('B1,"FAR",-40.0,100.0,10.0,199602,290, , ,S,1\n')
    rows = stations.load_precipitation(spark, str(tmp_path), (0, 90), (-180, 0)).orderBy("month").collect()
    assert [(r.id, r.year, r.month, r.value) for r in rows] == [("A1", 1996, 2, 1.0), ("A1", 1996, 3, None)]


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 2000, 1, 1.5, 40.0, -100.0, 1.0), ("a", 1999, 2, 2.5, 41.0, -100.0, 1.0)], "id string, year int, month int, value double, lat double, lon double, elev double")
    stations.write_store(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/obs")).count() == 2
    assert spark.read.parquet(str(tmp_path / "s/meta")).first().lat == 41.0


def test_fields(spark, tmp_path):
    raw = spark.createDataFrame([(-1.95, 10.0, 200.0, 273.15), (0.0, 10.0, 100.0, float("nan"))], "time double, lat double, lon double, value double")
    rows = fields.normalise(raw, "ka", "tas").collect()
    assert [(r.year, r.month, r.lon, r.value) for r in rows] == [(0, 1, -160.0, 0.0), (1950, 1, 100.0, None)]
    assert fields.files_of_years(["a_0000101-0010012.x", "a_0010101-0020012.x"], 101, 150) == ["a_0010101-0020012.x"]


def test_typed_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,extra,a\n1.5,zz,7\n,y,8\n")
    rows = fields.open_store(spark, str(tmp_path / "x.csv"), "a int, b double")
    assert rows.dtypes == [("a", "int"), ("b", "double")] and [tuple(r) for r in rows.orderBy("a").collect()] == [(7, 1.5), (8, None)]
    assert "extra" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    with pytest.raises(ValueError, match="no columns"):
        fields.open_store(spark, str(tmp_path / "x.csv"), "c int")
    assert fields.open_store(spark, str(tmp_path / "x.csv")).columns == ["b", "extra", "a"]


def test_runs_of_files(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "model_year int, month int, lat double, lon double, value double").coalesce(1).write.parquet(str(tmp_path / name))

    off = fields.S.MODEL_YEAR_OFFSET
    put("tas/tas_2500001-2509912.x", [(25000, 1, 10.0, 200.0, 273.15)])
    put("tas/tas_2510001-2519912.x", [(25150, 1, 10.0, 200.0, 274.15), (25150, 2, 10.0, 200.0, float("nan")), (25199, 1, 10.0, 100.0, 283.15)])
    put("tas/tas_2515001-2519912.x", [(25150, 1, 10.0, 200.0, 275.15)])
    put("pr/pr_2510001-2519912.x", [(25150, 1, 10.0, 200.0, 1 / 86400.0), (25150, 3, 10.0, 200.0, 0.0)])
    put("pr/pr_2520001-2529912.x", [(25200, 1, 10.0, 200.0, 1.0)])
    (tmp_path / "none").mkdir()
    folders = {v: str(tmp_path / v) for v in ("tas", "pr")}
    run = fields.load_run(spark, folders, "model_year", 25150 - off, 25160 - off)
    assert {f.rsplit("/", 2)[-2] for f in run.inputFiles()} == {"tas_2510001-2519912.x", "tas_2515001-2519912.x", "pr_2510001-2519912.x"}
    assert run.count() == 6 and "Exchange" not in run._jdf.queryExecution().executedPlan().toString()
    got = {(r.year + off, r.month, r.lon): (r.tas if r.tas is None else round(r.tas, 6), r.pr if r.pr is None else round(r.pr, 6)) for r in fields.joined(run, ["tas", "pr"]).collect()}
    assert got == {(25150, 1, -160.0): (2.0, 1.0), (25150, 2, -160.0): (None, None), (25150, 3, -160.0): (None, 0.0), (25199, 1, 100.0): (10.0, None)}
    assert fields.load_run(spark, folders, "model_year").count() == 8 and fields.load_run(spark, folders, "model_year", 5, 6).count() == 0
    assert fields.load_run(spark, folders, "model_year", first=25200 - off).count() == 1
    with pytest.raises(FileNotFoundError, match="none"):
        fields.load_run(spark, {"tas": str(tmp_path / "none")}, "model_year")


def test_product_round_trip_and_matrices(spark, tmp_path):
    cells = spark.createDataFrame([("p", "tas", 2000, 1, 0, 0, 1.234), ("p", "tas", 2000, 1, 0, 1, None)], "product string, var string, year int, month int, lat_idx int, lon_idx int, value double")
    fields.write_product(cells, str(tmp_path / "p"), packed=True)
    assert [r.value for r in fields.read_product(spark, str(tmp_path / "p"), packed=True).orderBy("lon_idx").collect()] == [1.23, None]
    (tmp_path / "m.bin").write_bytes(struct.pack("<ii", 2, 3) + np.arange(6, dtype="<f4").tobytes())
    assert [(r.row, r.col, r.value) for r in fields.read_matrices(spark, str(tmp_path / "m.bin")).orderBy("row", "col").collect()][4] == (1, 1, 4.0)
    fields.write_reconstruction(cells.select("year", "value"), str(tmp_path / "r"), csv=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).where("value = '1.2340'").count() == 1


def test_grid_and_nearest(spark):
    assert grids.NORTH_AMERICA.shape == (301, 601)
    df = spark.createDataFrame([(1.5,), (None,), (9.0,)], "x double")
    assert [r.i for r in df.select(grids.nearest_index(F.col("x"), [1.0, 2.0, 3.0]).alias("i")).collect()] == [0, None, 2]
    assert [r.i for r in df.select(grids.nearest_index_within(F.col("x"), [1.0, 2.0, 3.0]).alias("i")).collect()] == [0, None, None]


def test_seasons_and_labels(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "month int")
    counts = {r.season: r["count"] for r in selection.by_season(df).groupBy("season").count().collect()}
    assert counts == {"Annual": 12, "MAM": 3, "JJA": 3, "SON": 3, "DJF": 3}
    rows = spark.createDataFrame([("val", "cal"), ("val", "removed"), ("cal", "test_only"), (None, "cal"), ("cal", None)], "role string, flag string")
    assert [r.x for r in rows.select(selection.split_label(F.col("role"), F.col("flag")).alias("x")).collect()] == ["val", "removed", "test", "cal", "removed"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = tumbling_means(stream).writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.event_type, r.n) for r in tumbling_means(events).collect()}
    assert {(r.start, r.event_type, r.n) for r in spark.table("means").collect()} == want
