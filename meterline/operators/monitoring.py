"""Quality of past forecasts against what was measured later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from meterline.functions.clock import shift_steps
from meterline.functions.errors import accuracy
from meterline.session import KEY

ALERT_PERCENT = 20.0


def to_long(
    df: DataFrame, key: Sequence[str] = KEY, ts: str = "ts"
) -> DataFrame:
    """Wide forecasts ``pred_t+k`` (and ``true_ap+k`` where there) to one row per horizon step.

    ``target_ts`` is the stamp the forecast is for; a missing true value is null.
    """
    steps = sorted(int(c.split("+")[1]) for c in df.columns if c.startswith("pred_t+"))
    if not steps:
        raise ValueError("no prediction columns pred_t+<steps>")
    entries = [
        F.struct(
            F.lit(k).alias("horizon_step"),
            F.col(f"`pred_t+{k}`").cast("double").alias("y_pred"),
            (F.col(f"`true_ap+{k}`") if f"true_ap+{k}" in df.columns else F.lit(None))
            .cast("double").alias("y_true"),
        )
        for k in steps
    ]
    return df.select(*key, ts, F.inline(F.array(*entries))).withColumn(
        "target_ts", shift_steps(F.col(ts), F.col("horizon_step"))
    )


def monitor(
    sites: DataFrame,
    predictions: DataFrame,
    actual: DataFrame,
    limit: float = ALERT_PERCENT,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """One row per site: status, compared stamps, measures and the alert.

    ``predictions`` holds ``target_ts`` and ``y_pred``, ``actual`` holds ``ts`` and ``ap``. The alert
    is on when the mean relative error is above ``limit`` percent. Status is ``error`` without
    predictions, ``no_data`` without actual values, ``no_overlap`` when they share no stamp.
    """
    key = list(key)
    joined = predictions.join(actual.withColumnRenamed("ts", "target_ts"), [*key, "target_ts"])
    values = accuracy(F.col("ap"), F.col("y_pred"))
    scores = joined.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_comparisons"), *[c.alias(m) for m, c in values.items()]
    )
    predicted = predictions.select(*key).distinct().withColumn("_predicted", F.lit(True))
    measured = actual.select(*key).distinct().withColumn("_measured", F.lit(True))
    n = F.coalesce("n_comparisons", F.lit(0))
    status = (
        F.when(F.col("_predicted").isNull(), "error")
        .when(F.col("_measured").isNull(), "no_data")
        .when(n == 0, "no_overlap")
        .otherwise("success")
    )
    return (
        sites.select(*key).distinct()
        .join(predicted, key, "left").join(measured, key, "left").join(scores, key, "left")
        .select(
            *key, status.alias("status"), n.alias("n_comparisons"), *values,
            F.coalesce(F.col("mape") * 100 > limit, F.lit(False)).alias("degradation_alert"),
        )
    )


def monitor_summary(report: DataFrame) -> DataFrame:
    """Counts per energy type and the list of alerts."""
    alert = F.struct("site_id", "mape")
    return report.groupBy("etype").agg(
        F.count(F.lit(1)).alias("n_sites_monitored"),
        F.count_if(F.col("status") == "success").alias("n_sites_with_data"),
        F.count_if("degradation_alert").alias("n_degradation_alerts"),
        F.sort_array(F.collect_list(F.when(F.col("degradation_alert"), alert))).alias("alerts"),
    )
