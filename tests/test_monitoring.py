import datetime as dt

import pandas as pd
import pytest

from helpers import frame, series
from meterline.operators import monitoring


def test_long_forecasts(spark):
    df = spark.createDataFrame(
        [("c", 1, dt.datetime(2024, 1, 1, 10), 5.0, 7.0, 6.0)],
        ["etype", "site_id", "ts", "pred_t+1", "pred_t+4", "true_ap+1"],
    )
    rows = monitoring.to_long(df).orderBy("horizon_step").collect()
    assert [(r.horizon_step, r.y_pred, r.y_true, str(r.target_ts)[11:16]) for r in rows] == [
        (1, 5.0, 6.0, "10:15"), (4, 7.0, None, "11:00"),
    ]
    with pytest.raises(ValueError):
        monitoring.to_long(df.drop("pred_t+1", "pred_t+4"))


def site(spark, number, factor, shift="0min"):
    pdf = series(10, sites=(number,)).assign(ap=100.0)
    actual = pdf.copy()
    pred = pdf[["etype", "site_id"]].assign(target_ts=pdf["ts"] + pd.Timedelta(shift), y_pred=pdf["ap"] * factor)
    return actual, pred


def test_status_and_alerts(spark):
    parts = {1: (1.19, "0min"), 2: (1.21, "0min"), 3: (1.0, "10D"), 4: (1.2, "0min")}
    made = {s: site(spark, s, f, shift) for s, (f, shift) in parts.items()}
    actual = frame(spark, pd.concat([a for a, _ in made.values()] + [series(5, sites=(6,))]))
    pred = frame(spark, pd.concat([p for _, p in made.values()] + [site(spark, 5, 1.0)[1]]))
    sites = spark.createDataFrame([("consumption", s) for s in range(1, 8)], "etype string, site_id int")
    report = monitoring.monitor(sites, pred, actual)
    rows = {r.site_id: (r.status, r.n_comparisons, r.degradation_alert) for r in report.collect()}
    assert rows == {
        1: ("success", 10, False), 2: ("success", 10, True), 3: ("no_overlap", 0, False), 4: ("success", 10, False),
        5: ("no_data", 0, False), 6: ("error", 0, False), 7: ("error", 0, False),
    }
    summary = monitoring.monitor_summary(report).first()
    assert (summary.n_sites_monitored, summary.n_sites_with_data, summary.n_degradation_alerts) == (7, 3, 1)
    assert [a.site_id for a in summary.alerts] == [2]
