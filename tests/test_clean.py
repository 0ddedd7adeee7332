import pandas as pd

from helpers import frame, series, sorted_pandas
from meterline.operators import clean


def test_sign_and_zeros(spark):
    rows = [(0.0, 0.0, 0.0, True), (0.0, None, 0.0, True), (-5.0, 0.0, 1.0, True), (-5.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "ap double, q1 double, q4 double, production boolean")
    kept = clean.drop_all_zero(clean.abs_production(df)).collect()
    assert [(r.ap, r.q1, r.q4) for r in kept] == [(0.0, None, 0.0), (5.0, 0.0, 1.0), (-5.0, 0.0, 0.0)]


def test_periods_keep_the_last_day_but_its_midnight(spark):
    df = frame(spark, series(96 * 12, sites=(1, 2, 3, 4)))
    rows = [("consumption", 1, "2024-01-05", "2024-01-08"), ("consumption", 2, None, "2024-01-03"),
            ("consumption", 3, "2024-01-10", None), ("production", 4, None, None)]
    periods = spark.createDataFrame(rows, "etype string, site_id int, a string, b string").selectExpr(
        "etype", "site_id", "cast(a as timestamp) start_ts", "cast(b as timestamp) end_ts"
    )
    got = sorted_pandas(clean.drop_periods(df, periods), "site_id", "ts")
    ts = lambda s: got[got.site_id == s]["ts"]
    day = pd.Timestamp
    assert ts(1)[(ts(1) >= day("2024-01-05")) & (ts(1) <= day("2024-01-08"))].empty
    assert (ts(1) == day("2024-01-08 00:15")).any() and (ts(1) == day("2024-01-04 23:45")).any()
    assert ts(2).min() == day("2024-01-03 00:15") and ts(3).max() == day("2024-01-09 23:45")
    assert len(ts(4)) == 96 * 12


def test_no_periods(spark):
    df = frame(spark, series(5))
    empty = spark.createDataFrame([], "etype string, site_id int, start_ts timestamp, end_ts timestamp")
    assert clean.drop_periods(df, empty).count() == 5


def test_long_enough(spark):
    df = frame(spark, pd.concat([series(40, sites=(1,)), series(39, sites=(2,))]))
    assert {r.site_id for r in clean.long_enough(df, 4).collect()} == {1}


def test_delay_and_latest(spark):
    df = frame(spark, series(96 * 3, sites=(1, 2)))
    got = clean.latest(clean.known_until(df, "2024-01-03 10:07:33", 1)).collect()
    assert {str(r.ts) for r in got} == {"2024-01-02 10:00:00"} and len(got) == 2


def test_last_rows(spark):
    pdf = series(200, sites=(1, 2))
    got = sorted_pandas(clean.last_rows(frame(spark, pdf), 96), "site_id", "ts")
    want = pdf.groupby("site_id").tail(96).reset_index(drop=True)
    assert got["ts"].tolist() == want["ts"].tolist()


def test_listed_sites(spark):
    rows = spark.createDataFrame([("A.B", 1), ("A.B", 1), ("", 0), ("", 5), ("X", 2)], "site string, sn long")
    allowed = spark.createDataFrame([("A_B", "1"), ("", "0"), ("", "5")], "site string, sn string")
    assert {tuple(r) for r in clean.listed_sites(rows, allowed).collect()} == {("A.B", 1), ("", 5)}


def test_types_and_reactive(spark):
    df = spark.createDataFrame([("A-B", "7", "x", 1.0, 2.0)], "site string, sn string, dls string, q1 double, q4 double")
    row = clean.drop_reactive(clean.typed_readings(df)).first()
    assert row.asDict() == {"site": "A_B", "sn": 7, "ts": "x"}
