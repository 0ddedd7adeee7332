"""Queries run as streams over the tables; the result is the table a stream has written."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.registry import GRID, READINGS, query, rounded
from meterline.functions.clock import shift_steps
from meterline.plans import views
from meterline.session import KEY, scratch_path, use_utc
from meterline.streaming import live


def _stream(spark, sf):
    """The events table as a stream of readings."""
    schema = use_utc(spark).read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select(
        views.etype_of(F.col("event_type")).alias("etype"),
        (F.col("user_id") % 7 + 1).cast("int").alias("site_id"),
        F.col("ts").cast("timestamp").alias("dls"), F.col("value").alias("ap"),
    )


@query(
    "live_totals",
    f"""WITH {READINGS} SELECT etype, site_id, time_bucket(INTERVAL '15 minutes', dls) AS ts, round(sum(ap), 6) AS ap FROM r GROUP BY 1, 2, 3""",
)
def live_totals(spark, sf):
    path = scratch_path(spark, "live-totals")
    totals = live.live_totals(_stream(spark, sf))
    live.run_to_table(totals, path, "update")
    return rounded(live.read_updates(spark, path, [*KEY, "ts"], totals.schema), "ap")


@query(
    "live_monitoring",
    f"""WITH {GRID} SELECT a.etype, a.site_id, count(*) AS n, round(avg(abs(a.ap - p.ap)), 6) + 0.0::DOUBLE AS mae
FROM g a JOIN g p ON a.etype = p.etype AND a.site_id = p.site_id AND a.ts = p.ts + INTERVAL 15 MINUTE GROUP BY 1, 2""",
)
def live_monitoring(spark, sf):
    """Naive forecasts and totals, written once as tables, read back as two streams and joined."""
    path = scratch_path(spark, "live-monitoring")
    grid = views.grid(spark, sf)
    grid.write.parquet(f"{path}/actual")
    grid.select(*KEY, shift_steps(F.col("ts"), 1).alias("target_ts"), F.col("ap").alias("y_pred")).write.parquet(
        f"{path}/predicted"
    )
    actual = spark.readStream.schema(spark.read.parquet(f"{path}/actual").schema).parquet(f"{path}/actual")
    predicted = spark.readStream.schema(spark.read.parquet(f"{path}/predicted").schema).parquet(f"{path}/predicted")
    pairs = live.live_pairs(predicted, actual)
    live.run_to_table(pairs, path)
    rows = spark.read.schema(pairs.schema).parquet(f"{path}/rows")
    scored = live.batch_alerts(rows).select(*KEY, "n", "mae")
    return rounded(scored, "mae")
