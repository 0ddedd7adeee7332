import datetime as dt
import os

import pandas as pd
import pytest

from helpers import frame, series, sorted_pandas
from meterline.operators import decide
from meterline.sources import readings, results, tables, weather


def write_csv(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    lines = ["site,sn,dls,ap,q1,q4"] + [",".join(map(str, r)) for r in rows]
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture
def raw(tmp_path):
    folder = str(tmp_path / "raw")
    stamp = "2024-01-01 00:{:02d}:00".format
    write_csv(folder, "std_A.B_7.csv", [("A.B", 7, stamp(0), 1, 0, 0), ("A.B", 7, stamp(40), 2, 0, 0), ("A.B", 7, stamp(50), 0, 0, 0)])
    write_csv(folder, "std_2015_A.B_7.csv", [("A.B", 7, stamp(0), 10, 0, 0), ("A.B", 7, stamp(5), 20, "", 0)])
    write_csv(folder, "std_2016_A-B_7.csv", [("A-B", 7, stamp(0), -4, -1, 0), ("A-B", 7, stamp(16), -5, 0, 0)])
    write_csv(folder, "std_ONE_1.csv", [("ONE", 1, stamp(0), 5, 0, 0)])
    write_csv(folder, "std_ZERO_2.csv", [("ZERO", 2, stamp(0), 0, 0, 0), ("ZERO", 2, stamp(15), 0, 0, 0)])
    return folder


def test_ingest(spark, raw):
    got = sorted_pandas(readings.ingest(readings.read_files(spark, raw)), "site_key", "ts")
    by = {k: rows["ap"].tolist() for k, rows in got.groupby("site_key")}
    assert by == {"/site_A_B_7/consumption": [31.0, 0.0, 2.0], "/site_AB_7/production": [4.0, 5.0]}


def test_ingest_of_allowed_keys_without_repeats(spark, raw):
    allowed = spark.createDataFrame([("/site_A_B_7/consumption",)], "site_key string")
    got = sorted_pandas(readings.ingest(readings.read_files(spark, raw), allowed, dedupe=True), "ts")
    assert got["site_key"].unique().tolist() == ["/site_A_B_7/consumption"]
    # Of the two readings at 00:00 one is kept, the other file's second reading adds to it.
    assert got["ap"].tolist()[0] in (21.0, 30.0)


def test_series_store_replaces_a_key(spark, path):
    a, b = (series(50).assign(site_key=k) for k in "ab")
    cols = ["etype", "site_key", "ts", "ap"]
    readings.write_series(frame(spark, pd.concat([a, b])[cols]), path)
    readings.write_series(frame(spark, a.assign(ap=1.0).head(3)[cols]), path)
    assert readings.read_series(spark, path, "a").count() == 3
    assert readings.read_series(spark, path, "b").count() == 50
    plan = readings.read_series(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_key" in plan


def test_extract_by_table_kind(spark):
    full = spark.createDataFrame([("S", 1, "2024-01-01", 1.0, 2.0, 3.0, "x")], "site string, sn long, dls string, ap double, q1 double, q4 double, more string")
    seen = []

    def reader(name):
        seen.append(name)
        return full

    got = tables.extract(reader, {"live": ["std", "cpt6"], "archive": ["std_2010", "std_smart", "std_pv"]})
    assert seen == ["live.std", "archive.std_2010", "archive.std_smart", "archive.std_pv"]
    rows = {r.table: r for r in got.collect()}
    assert rows["std_smart"].q1 is None and rows["std_pv"].more == "x" and rows["std_2010"].more is None
    assert rows["std_pv"].table_rank == 2
    assert tables.columns_of("cpt6") == tables.INDEX_COLUMNS


def test_range_scan(spark):
    rows = [
        # site, sn, dls, ap, database_rank, table_rank
        ("A", 1, "2024-01-01 10:00", 1.0, 0, 1), ("A", 1, "2024-01-01 11:00", 2.0, 0, 2),
        ("A", 1, "2024-01-01 10:00", 3.0, 1, 0), ("A", 1, "2024-01-01 12:00", 4.0, 1, 0),
        ("A", 1, "2023-12-31 12:00", 9.0, 0, 0), ("B", 1, "2024-01-01 23:59", 5.0, 0, 2),
        ("C", 1, "2024-01-02 00:01", 6.0, 0, 0),
    ]
    df = spark.createDataFrame(rows, "site string, sn long, dls string, ap double, database_rank int, table_rank int")
    got = tables.range_scan(df, "2024-01-01 00:00", "2024-01-02 00:00", order=["ap"])
    assert sorted((r.site, r.ts[11:], r.ap) for r in got.collect()) == [
        ("A", "10:00", 1.0), ("A", "12:00", 4.0), ("B", "23:59", 5.0),
    ]
    only = spark.createDataFrame([("B", 1)], "site string, sn long")
    assert tables.range_scan(df, "2024-01-01 00:00", "2024-01-02 00:00", only, ["ap"]).count() == 1


def test_weather_files(spark, path):
    cols = ", ".join(f"cast(id as double) {c}" for c in weather.WEATHER_COLUMNS)
    df = spark.range(3).selectExpr("timestamp'2023-12-31 23:50:00' + make_dt_interval(0, 0, 10 * cast(id as int)) ts", cols.split(", ")[0], *cols.split(", ")[1:])
    weather.write_weather(df, path)
    back = weather.read_weather(spark, path)
    assert back.columns == ["ts", *weather.WEATHER_COLUMNS] and back.count() == 3
    assert sorted(os.listdir(path))[-2:] == ["year=2023", "year=2024"]
    grid = sorted_pandas(weather.weather_grid(back), "ts")
    assert grid["pressure"].tolist() == [0.0, 1.0]
    assert len(weather.schema()) == 18


def test_station(spark):
    observed = spark.createDataFrame([("p1", 1), ("p2", 2)], "the_geom string, v int")
    stations = spark.createDataFrame([("HERE", "p2"), ("THERE", "p1")], "name string, the_geom string")
    assert [r.v for r in weather.of_station(observed, stations, "HERE").collect()] == [2]


def predictions(spark):
    rows = [("consumption", 1, dt.datetime(2024, 1, 1, 10), 5.0, 6.0), ("consumption", 1, dt.datetime(2024, 1, 1, 10, 15), 7.0, 8.0),
            ("production", 2, dt.datetime(2024, 1, 1, 9), 1.0, None)]
    return spark.createDataFrame(rows, "etype string, site_id int, ts timestamp, `pred_t+1` double, `true_ap+1` double")


def test_snapshot(spark, path):
    results.write_snapshot(predictions(spark), path)
    with open(os.path.join(path, "etype=production", "site_id=2", "extra.json"), "w") as f:
        f.write('{"ts": "not a time", "pred_t+1": 99.0}\n')
    got = {r.site_id: (str(r.ts), r["pred_t+1"]) for r in results.read_snapshot(spark, path).collect()}
    assert got == {1: ("2024-01-01 10:15:00", 7.0), 2: ("2024-01-01 09:00:00", 1.0)}


def test_history(spark, path):
    for run in ("r1", "r2"):
        results.write_history(results.history(predictions(spark), run, "2026-03-24T15:58:26", "h5", "next_step"), path)
    back = spark.read.parquet(path)
    assert back.count() == 6 and set(results.HISTORY_COLUMNS) <= set(back.columns)
    assert results.history(predictions(spark), "r", "t", "h5", "batch").columns == results.HISTORY_COLUMNS
    assert os.path.isdir(os.path.join(path, "etype=consumption", "site_id=1", "date=2026-03-24"))


def test_reports_and_features(spark, path):
    rows = [("consumption", 1, 2, "b"), ("consumption", 1, 1, "a"), ("production", 1, 1, "z")]
    results.write_report(spark.createDataFrame(rows, "etype string, site_id int, rank int, feature string"), path)
    back = results.read_report(spark, path)
    assert results.selected_features(back, "consumption", 1) == ["a", "b"]
    with pytest.raises(ValueError):
        results.selected_features(back, "consumption", 9)


def test_results_csv_and_arrays(spark, path):
    results.write_results_csv(spark.createDataFrame([("knn", 0.5)], "model string, mae double"), path + "csv")
    assert spark.read.option("header", True).csv(path + "csv").first().model == "knn"
    arrays = spark.createDataFrame([([[1.0, 2.0]], [3.0])], "x array<array<double>>, y array<double>")
    results.write_arrays(arrays, path)
    assert results.read_arrays(spark, path).collect() == arrays.collect()


def test_xml_report(spark, path):
    ts = dt.datetime(2024, 6, 1, 10)
    cons = spark.createDataFrame([("k1", ts, 12100.0), ("k1", ts + dt.timedelta(minutes=15), 4.0)], "site_key string, ts timestamp, p double")
    prod = spark.createDataFrame([(ts, "a", 5.0), (ts, "b", 3.0)], "ts timestamp, site_id string, p double")
    caps = spark.createDataFrame([(ts, 4.0)], "ts timestamp, cap double")
    results.write_xml_report(cons, prod.selectExpr("site_id site_key", "ts", "p"), decide.shed(prod, caps), path)

    def text(section):
        folder = os.path.join(path, section)
        return "".join(open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.startswith("part"))

    assert '<entry timestamp="2024-06-01 10:00">12100.0</entry>' in text("consumption")
    assert '<site name="a"' in text("production")
    assert '<entry timestamp="2024-06-01 10:00" status="true">' in text("violation") and "<site>a</site>" in text("violation")
