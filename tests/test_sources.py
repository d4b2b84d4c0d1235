import datetime as dt

import numpy as np
import pytest

from rillstone.operators import evaluate
from rillstone.sources import readers, writers


def test_raw_files(spark, tmp_path):
    (tmp_path / "a_raw.txt").write_text("01/02/2024 03:05:00,400001,3,101,N,ML,0.5,10,100,55,NaN,61.5\n01/02/2024 03:10:00,x,3,101,N,ML,,10,100,,0.1,\n")
    got = readers.read_raw(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert got[0].timestamp == dt.datetime(2024, 1, 2, 3, 5) and got[0].station_id == 400001 and got[0].flow == 55.0 and got[0].occupancy is None
    assert got[1].station_id is None and got[1].station_length is None and got[1].speed is None and "_skip2" not in got[0].asDict()


def test_text_tables(spark, tmp_path):
    (tmp_path / "m.txt").write_text("ID\tFwy,Lat\n1\t5,37.0\n2,7\t\n")
    rows = readers.read_split_text(spark, str(tmp_path / "m.txt"))
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "5", "37.0"), ("2", "7", None)]
    named = readers.normalize_columns(rows, ["station_id", "lat"])
    assert named.columns == ["station_id", "fwy", "lat"]
    with pytest.raises(ValueError, match="length"):
        readers.normalize_columns(rows, ["length"])
    assert readers.rename_kept(rows, {"ID": "a", "Lat": "b"}).columns == ["a", "b"] and readers.rename_last(rows, "z").columns[-1] == "z"


def test_dispatch_and_dates(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:05:00")], "station_id long, timestamp string")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "out"))
    (path,) = (tmp_path / "out").glob("*.csv")
    path.rename(tmp_path / "health 01152024.csv")
    got = readers.with_file_date(readers.read_any(spark, str(tmp_path / "health 01152024.csv"))).first()
    assert got.timestamp == dt.datetime(2024, 1, 1, 0, 5) and got.date == dt.date(2024, 1, 15)
    writers.write_parquet(df.withColumn("timestamp", df["timestamp"].cast("timestamp_ntz")), str(tmp_path / "p"), "timestamp")
    assert readers.read_parquet(spark, str(tmp_path / "p"), ["station_id"]).columns == ["station_id"]
    with pytest.raises(ValueError, match="nope"):
        readers.read_parquet(spark, str(tmp_path / "p"), ["nope"])
    assert readers.time_range(readers.read_any(spark, str(tmp_path / "p"))).first().lo == dt.datetime(2024, 1, 1, 0, 5)


def test_either_schema(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, flow_interp double, speed double")
    assert readers.either_schema(df, ["flow", "speed"]).columns == ["id", "flow", "speed"]
    with pytest.raises(ValueError, match="occupancy"):
        readers.either_schema(df, ["occupancy"])


def test_saved_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"features": [{"properties": {"t": 1.5, "w": "x"}}, {"properties": {"t": null}}]}')
    assert sorted((tuple(r) for r in readers.read_features(spark, str(tmp_path), "t double, w string").collect()), key=str) == [(1.5, "x"), (None, None)]


def test_time_formats(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("01/02/2024 03:04:05",), ("?",)], "s string")
    assert [r[0] for r in df.select(readers.parse_time("s")).collect()] == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 2 + [None]


def test_metric_files(spark, tmp_path):
    df = spark.createDataFrame([("r", "5", 1.5)], "run_id string, horizon_min string, mae double")
    writers.write_metrics(df, str(tmp_path / "m"))
    writers.write_metrics(df, str(tmp_path / "m"), append=True)
    got = writers.read_metrics(spark, str(tmp_path / "m")).collect()
    assert len(got) == 2 and got[0].mae == 1.5 and got[0].rmse is None and list(got[0].asDict()) == evaluate.METRIC_COLUMNS


def test_small_exports(spark, tmp_path):
    writers.write_json(spark, {"b": 1, "a": [2]}, str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a": [2], "b": 1}']
    panel = spark.createDataFrame([(0, 0, 1.0), (1, 1, None)], "time_idx long, node_idx long, v double")
    dense = writers.export_dense(panel, ["v"])
    assert dense.shape == (2, 2, 1) and dense[0, 0, 0] == 1 and np.isnan(dense[1, 1, 0])
    with pytest.raises(ValueError, match="too large"):
        writers.export_dense(panel, ["v"], 3)
