import datetime as dt
import os

import pandas as pd

from helpers import frame, series
from meterline.streaming import live


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(folder, name))


SCHEMA = "etype string, site_id int, dls timestamp, ap double"


def batch(minutes_and_values):
    return [("c", 1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), v) for m, v in minutes_and_values]


def test_late_rows_are_dropped_from_the_stream_only(spark, path):
    source = os.path.join(path, "in")
    totals = None
    # Three runs of one stream; the last row of the second comes after its step was closed.
    for i, rows in enumerate([[(0, 1.0), (10, 2.0), (200, 4.0)], [(201, 8.0)], [(5, 100.0), (400, 16.0)]]):
        write(spark, source, f"b={i}", batch(rows), SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(source + "/*")
        totals = live.live_totals(stream, delay="1 hour")
        live.run_to_table(totals, os.path.join(path, "out"), "append")
    got = {str(r.ts)[11:16]: r.ap for r in spark.read.parquet(os.path.join(path, "out", "rows")).collect()}
    assert got["00:00"] == 3.0 and got["03:15"] == 12.0 and "06:30" not in got


def test_updates_keep_the_last_state(spark, path):
    source = os.path.join(path, "in")
    for i, rows in enumerate([[(0, 1.0), (20, 5.0)], [(1, 2.0)]]):
        write(spark, source, f"b={i}", batch(rows), SCHEMA)
        totals = live.live_totals(spark.readStream.schema(SCHEMA).parquet(source + "/*"))
        live.run_to_table(totals, os.path.join(path, "out"), "update")
    got = live.read_updates(spark, os.path.join(path, "out"), ["etype", "site_id", "ts"], totals.schema)
    assert {str(r.ts)[11:16]: r.ap for r in got.collect()} == {"00:00": 3.0, "00:15": 5.0}


def test_live_pairs(spark, path):
    pdf = series(20).assign(ap=100.0)
    frame(spark, pdf).write.parquet(path + "/a")
    pred = pdf[["etype", "site_id"]].assign(target_ts=pdf["ts"] + pd.Timedelta("30min"), y_pred=130.0)
    frame(spark, pred).write.parquet(path + "/p")
    read = lambda p: spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)
    pairs = live.live_pairs(read(path + "/p"), read(path + "/a"))
    live.run_to_table(pairs, path + "/out")
    rows = spark.read.parquet(path + "/out/rows")
    alert = live.batch_alerts(rows).first()
    assert alert.n == 18 and alert.degradation_alert
