"""Queries that write a result, read it back and return what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.registry import GRID, POSITIONS, query
from meterline.operators import clean
from meterline.plans import views
from meterline.session import scratch_path
from meterline.sources import profile, readings, results


def _forecasts(spark, sf):
    """The naive forecast of the last 96 steps of each site."""
    recent = clean.last_rows(views.grid(spark, sf))
    return recent.select("etype", "site_id", "ts", F.col("ap").alias("pred_t+1"), (F.col("ap") * 2).alias("pred_t+4"))


@query("stored_series", f"WITH {GRID} SELECT etype, 'S' || site_id AS site_key, ts, ap FROM g")
def stored_series(spark, sf):
    path = scratch_path(spark, "series")
    key = F.concat(F.lit("S"), F.col("site_id").cast("string")).alias("site_key")
    readings.write_series(views.grid(spark, sf).select("etype", key, "ts", "ap"), path)
    return readings.read_series(spark, path).select("etype", "site_key", "ts", "ap")


@query(
    "stored_snapshot",
    f"""WITH {POSITIONS} SELECT etype, site_id, ts, ap AS "pred_t+1", ap * 2 AS "pred_t+4" FROM p WHERE pos = n - 1""",
)
def stored_snapshot(spark, sf):
    path = scratch_path(spark, "snapshot")
    results.write_snapshot(_forecasts(spark, sf), path)
    return results.read_snapshot(spark, path).select("etype", "site_id", "ts", "`pred_t+1`", "`pred_t+4`")


@query(
    "stored_history",
    f"""WITH {POSITIONS}, h AS (SELECT unnest([1, 4]) AS horizon_step)
SELECT 'r1' AS run_id, '2024-02-01 00:00:00' AS created_at_utc, etype, site_id, 'files' AS data_source, 'batch' AS inference_mode,
  ts, ts + horizon_step * INTERVAL 15 MINUTE AS target_ts, horizon_step, CASE horizon_step WHEN 1 THEN ap ELSE ap * 2 END AS y_pred,
  CAST(NULL AS DOUBLE) AS y_true
FROM p, h WHERE pos >= n - 96""",
)
def stored_history(spark, sf):
    path = scratch_path(spark, "history")
    rows = results.history(_forecasts(spark, sf), "r1", "2024-02-01 00:00:00", "files", "batch")
    results.write_history(rows, path)
    return spark.read.parquet(path).select(*results.HISTORY_COLUMNS)


@query(
    "stored_demand",
    """WITH d AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS TIMESTAMP) AS ts, sum(o_totalprice) AS power FROM orders GROUP BY 1, 2
) SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(power, 2) AS power_w, year FROM d""",
)
def stored_demand(spark, sf):
    path = scratch_path(spark, "demand")
    days = views.table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("timestamp").alias("ts")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("power_w"))
    parts = [days.where(F.col("year") % 2 == rest) for rest in (0, 1)]
    profile.write_demand(profile.demand_curve(parts), path)
    return spark.read.schema("ts string, power_w double, year int").option("header", True).csv(path)
