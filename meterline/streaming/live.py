"""Live 15-minute totals and live monitoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.operators.monitoring import ALERT_PERCENT
from meterline.session import KEY


def live_totals(
    stream: DataFrame,
    key: Sequence[str] = KEY,
    ts: str = "dls",
    delay: str = "1 hour",
    sums: Sequence[str] = ("ap",),
) -> DataFrame:
    """Totals per key and 15-minute step; a row later than ``delay`` is dropped once its step is
    closed. State holds the open steps only."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*key, F.window(ts, "15 minutes").alias("_w"))
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(*key, F.col("_w.start").alias("ts"), *sums)
    )


def live_pairs(
    predictions: DataFrame,
    actual: DataFrame,
    key: Sequence[str] = KEY,
    delay: str = "1 hour",
) -> DataFrame:
    """Forecasts joined to the values measured for their ``target_ts``.

    Both sides carry a watermark and the stamps must be equal, so the state of a stamp is dropped
    once both sides are past it.
    """
    left = predictions.withWatermark("target_ts", delay).alias("pred")
    right = actual.withWatermark("ts", delay).alias("act")
    same = F.col("pred.target_ts") == F.col("act.ts")
    for c in key:
        same = same & (F.col(f"pred.{c}") == F.col(f"act.{c}"))
    return left.join(right, same, "inner").select(
        *[F.col(f"pred.{c}").alias(c) for c in key],
        F.col("act.ts").alias("ts"), F.col("pred.y_pred").alias("p"), F.col("act.ap").alias("y"),
    )


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over all that is there and write each batch under ``path``.

    A batch is a folder of its own that is overwritten when the batch runs again, so a restart after
    a failure leaves no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def read_updates(
    spark: SparkSession, path: str, by: Sequence[str], schema
) -> DataFrame:
    """Last state of each group written by an ``update`` stream."""
    fields = [f.name for f in schema.fields]
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in fields else schema)
    rest = [c for c in fields if c not in by and c != "batch"]
    return (
        rows.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
        .groupBy(*by)
        .agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row"))
        .select(*by, "_row.*")
    )


def batch_alerts(pairs: DataFrame, limit: float = ALERT_PERCENT, key: Sequence[str] = KEY) -> DataFrame:
    """Measures and alert per site of the pairs at hand; used per batch or on the written table."""
    from meterline.operators.accuracy import metrics

    scored = metrics(pairs, key)
    return scored.withColumn("degradation_alert", F.col("mape") * 100 > limit)
