import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from meterline.functions.calendar import CALENDAR_COLUMNS, calendar_features, easter_sunday, holiday_dates, is_holiday

# Dates of Easter Sunday.
EASTER = (
    "2010-04-04 2011-04-24 2012-04-08 2013-03-31 2014-04-20 2015-04-05 2016-03-27 2017-04-16 2018-04-01 2019-04-21 "
    "2020-04-12 2021-04-04 2022-04-17 2023-04-09 2024-03-31 2025-04-20 2026-04-05 2027-03-28 2028-04-16 2029-04-01 "
    "2030-04-21 1954-04-18 1981-04-19 2049-04-18 2076-04-19"
).split()


def test_easter(spark):
    years = spark.createDataFrame([(int(d[:4]),) for d in EASTER], "y int")
    got = {r.y: str(r.e) for r in years.select("y", easter_sunday(F.col("y")).alias("e")).collect()}
    assert got == {int(d[:4]): d for d in EASTER}


def test_holidays_of_a_year(spark):
    row = spark.range(1).select(holiday_dates(F.lit(2024)).alias("d")).first()
    want = "01-01 04-01 05-01 05-09 05-20 07-21 08-15 11-01 11-11 12-25".split()
    assert [str(d)[5:] for d in row.d] == want


def test_only_midnight_is_marked_by_default(spark):
    df = spark.sql("select explode(array(timestamp'2024-07-21 00:00:00', timestamp'2024-07-21 00:15:00', timestamp'2024-07-22 00:00:00')) ts")
    rows = df.select(is_holiday(F.col("ts")).alias("a"), is_holiday(F.col("ts"), "day").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(True, True), (False, True), (False, False)]


def test_calendar_equals_pandas(spark):
    stamps = pd.date_range("2019-12-20", "2021-01-15", freq="6h")
    df = spark.createDataFrame(pd.DataFrame({"ts": stamps})).withColumns(calendar_features(F.col("ts")))
    got = df.toPandas().sort_values("ts").reset_index(drop=True)
    assert list(got.columns[1:]) == CALENDAR_COLUMNS
    assert got["dayofweek"].tolist() == stamps.dayofweek.tolist()
    assert got["weekofyear"].tolist() == stamps.isocalendar().week.tolist()
    seasons = {12: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 3, 10: 3, 11: 3}
    assert got["season"].tolist() == [seasons[m] for m in stamps.month]
    peak = [7 <= t.hour <= 22 and t.dayofweek <= 4 for t in stamps]
    assert got["is_peak_hour"].tolist() == [int(p) for p in peak]
    assert got["holiday"].sum() == sum(t.time() == dt.time(0) and (t.month, t.day) in
                                      {(1, 1), (5, 1), (7, 21), (8, 15), (11, 1), (11, 11), (12, 25)} for t in stamps) + 3
