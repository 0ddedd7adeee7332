import numpy as np
import pandas as pd
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from helpers import frame, series, sorted_pandas
from meterline.operators import regular
from meterline.operators.chunks import fill
from meterline.session import stored


def readings(spark, rows):
    pdf = pd.DataFrame(rows, columns=["dls", "ap", "q1", "q4"])
    pdf["dls"] = pd.to_datetime(pdf["dls"])
    return spark.createDataFrame(pdf.assign(site_key="k", site="S", sn=7))


def test_resample_adds_duplicates_and_fills_empty_steps(spark):
    df = readings(
        spark,
        [("2024-01-01 00:00", 1.0, 1.0, 0.0), ("2024-01-01 00:00", 2.0, 1.0, 0.0),
         ("2024-01-01 00:20", 4.0, 1.0, 0.0), ("2024-01-01 01:00", 8.0, 1.0, 0.0)],
    )
    got = sorted_pandas(regular.resample(df, ["site_key"], firsts=["site", "sn"]), "ts")
    assert got["ap"].tolist() == [3.0, 4.0, 0.0, 0.0, 8.0]
    assert got["site"].tolist() == ["S"] * 5 and got["sn"].tolist() == [7] * 5


def test_resample_equals_pandas(spark):
    rng = np.random.default_rng(3)
    stamps = pd.Timestamp("2024-03-01") + pd.to_timedelta(np.sort(rng.integers(0, 40 * 86400, 500)), unit="s")
    pdf = pd.DataFrame({"site_key": "k", "dls": stamps, "ap": rng.random(500)})
    got = sorted_pandas(regular.resample(spark.createDataFrame(pdf), ["site_key"], sums=["ap"]), "ts")
    want = pdf.set_index("dls")["ap"].resample("15min").sum()
    assert got["ts"].tolist() == want.index.tolist()
    assert np.allclose(got["ap"], want.to_numpy())


def test_grid_counts_from_the_first_stamp(spark):
    pdf = series(6)
    pdf["ts"] = pd.to_datetime(
        ["2024-01-01 00:05", "2024-01-01 00:20", "2024-01-01 00:30", "2024-01-01 00:50", "2024-01-01 01:05", "2024-01-01 01:12"]
    )
    got = sorted_pandas(regular.regular_grid(frame(spark, pdf)), "ts")
    want = pdf.set_index("ts")["ap"].asfreq("15min")
    assert got["ts"].tolist() == want.index.tolist()
    assert got["ap"].isna().tolist() == want.isna().tolist()


def test_grid_over_several_chunks(spark):
    pdf = series(3000).iloc[[0, 5, 2999]]
    assert regular.regular_grid(frame(spark, pdf)).count() == 3000


def test_weather_takes_the_first_value_of_a_step(spark):
    rows = [("2024-01-01 00:00", None, 1.0), ("2024-01-01 00:10", 3.0, 2.0), ("2024-01-01 00:20", 4.0, None),
            ("2024-01-01 00:50", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "t string, temp double, sun double").selectExpr("cast(t as timestamp) ts", "temp", "sun")
    got = sorted_pandas(regular.first_in_bin(df, ["temp", "sun"]), "ts")
    assert got["temp"].tolist()[:2] == [3.0, 4.0] and np.isnan(got["temp"][2]) and got["temp"][3] == 5.0
    assert got["sun"].tolist()[0] == 1.0 and np.isnan(got["sun"][1])


@pytest.mark.parametrize("how", ["both", "forward"])
def test_weather_join_fills_inside_the_series_only(spark, how):
    n = 3000
    weather = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="15min")})
    rng = np.random.default_rng(4)
    for c in ("temp", "sun"):
        weather[c] = np.where(rng.random(n) < 0.02, rng.random(n).round(3), np.nan)
    left = series(n - 500, sites=(1,), start="2024-01-02 06:00")
    right = series(2000, sites=(2,), start="2023-12-28")
    late = series(1800, sites=(3,), start="2024-01-20")
    pdf = pd.concat([left, right, late], ignore_index=True)
    got = sorted_pandas(regular.join_weather(frame(spark, pdf), frame(spark, weather), how=how), "site_id", "ts")
    parts = []
    for site, rows in pdf.groupby("site_id"):
        w = weather.set_index("ts").reindex(rows["ts"]).ffill()
        parts.append(w.bfill() if how == "both" else w)
    want = pd.concat(parts).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["temp", "sun"]], want, check_names=False)
    plain = frame(spark, pdf).join(frame(spark, weather), "ts", "left")
    slow = sorted_pandas(fill(plain, ["temp", "sun"], how=how), "site_id", "ts")
    pd.testing.assert_frame_equal(got[["temp", "sun"]], slow[["temp", "sun"]])


def test_weather_without_a_common_stamp_is_an_error(spark):
    weather = pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=8, freq="15min"), "temp": 1.0})
    joined = regular.join_weather(frame(spark, series(8)), frame(spark, weather))
    with pytest.raises(SparkRuntimeException, match="no stamp in common"):
        joined.collect()


def test_strict_lookup(spark):
    weather = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=8, freq="15min"), "temp": 1.0})
    assert regular.lookup_weather(frame(spark, series(8)), frame(spark, weather)).count() == 8
    with pytest.raises(SparkRuntimeException, match="no weather at"):
        regular.lookup_weather(frame(spark, series(9)), frame(spark, weather)).collect()


def members(spark, rows):
    return spark.createDataFrame(rows, "etype string, site_id int, site_key string")


def test_group_sum_counts_missing_members_as_zero(spark):
    a = series(4).assign(site_key="a", ap=1.0)
    b = series(4, start="2024-01-01 00:30").assign(site_key="b", ap=10.0)
    b = b.drop(b.index[1])
    rows = frame(spark, pd.concat([a, b])[["site_key", "ts", "ap"]])
    groups = members(spark, [("consumption", 1, "a"), ("consumption", 1, "b"), ("consumption", 1, "gone"), ("production", 2, "b")])
    got = sorted_pandas(regular.group_sum(rows, groups), "site_id", "ts")
    assert got[got.site_id == 1]["ap"].tolist() == [1.0, 1.0, 11.0, 1.0, 10.0, 10.0]
    assert got[got.site_id == 2]["ap"].tolist() == [10.0, 0.0, 10.0, 10.0]


def test_group_without_any_series(spark):
    rows = frame(spark, series(4).assign(site_key="a")[["site_key", "ts", "ap"]])
    groups = members(spark, [("consumption", 1, "a"), ("consumption", 9, "gone")])
    with pytest.raises(SparkRuntimeException, match="no source series for group consumption/9"):
        regular.group_sum(rows, groups).collect()
    assert regular.group_sum(rows, groups, strict=False).count() == 4


def test_zero_grid_sum_spans_the_whole_group(spark):
    a = series(2).assign(site_key="a", ap=1.0)
    b = series(2, start="2024-01-01 01:30").assign(site_key="b", ap=5.0)
    rows = frame(spark, pd.concat([a, b])[["site_key", "ts", "ap"]])
    groups = members(spark, [("consumption", 1, "a"), ("consumption", 1, "b")])
    assert sorted_pandas(regular.zero_grid_sum(rows, groups), "ts")["ap"].tolist() == [1, 1, 0, 0, 0, 0, 5, 5]
    left_out = groups.where("site_key = 'b'").select("site_key")
    assert regular.zero_grid_sum(rows, groups, left_out).count() == 2


def test_grid_is_not_broadcast_for_its_small_files(spark):
    """300,000 steps of zeros are some kilobytes as files, but many megabytes once collected for a broadcast."""
    rows = stored(spark.range(300_000).selectExpr(
        "id div 300 as k", "timestamp_seconds(1704067200 + (id % 300) * 1800) as ts", "0.0D as ap"))
    grid = regular.regular_grid(rows, ["k"])
    plan = grid._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    got = grid.groupBy("k").agg(F.count("*").alias("n"), F.count("ap").alias("known"))
    assert [tuple(r) for r in got.select("n", "known").distinct().collect()] == [(599, 300)]
