"""Forecasts, reports, models and features written and read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.operators.clean import latest
from meterline.operators.monitoring import to_long
from meterline.session import KEY

# Columns of the forecast history, in order.
HISTORY_COLUMNS = [
    "run_id", "created_at_utc", "etype", "site_id", "data_source", "inference_mode",
    "ts", "target_ts", "horizon_step", "y_pred", "y_true",
]


def write_snapshot(predictions: DataFrame, path: str) -> None:
    """Latest forecasts, one folder per energy type and site, replacing those of the same sites."""
    (
        predictions.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("etype", "site_id")
        .json(path)
    )


def read_snapshot(spark: SparkSession, path: str, key: Sequence[str] = KEY) -> DataFrame:
    """Latest point of each site; a point whose stamp cannot be read does not count."""
    rows = spark.read.json(path)
    dated = rows.withColumn("ts", F.try_to_timestamp(F.col("ts").cast("string")))
    return latest(dated.where("ts is not null"), key)


def history(
    predictions: DataFrame, run_id: str, created_at_utc: str, data_source: str, inference_mode: str
) -> DataFrame:
    """Forecasts in the eleven columns of the history."""
    labels = {
        "run_id": F.lit(run_id), "created_at_utc": F.lit(created_at_utc),
        "data_source": F.lit(data_source), "inference_mode": F.lit(inference_mode),
    }
    return to_long(predictions).withColumns(labels).select(*HISTORY_COLUMNS)


def write_history(rows: DataFrame, path: str) -> None:
    """Append to the history, by energy type, site and day of the run."""
    rows.withColumn("date", F.substring("created_at_utc", 1, 10)).write.mode("append").partitionBy(
        "etype", "site_id", "date"
    ).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report, a feature list or best parameters as JSON lines."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def selected_features(report: DataFrame, etype: str, site_id: int) -> list[str]:
    """Feature names of one site by rank; none is an error."""
    mine = report.where((F.col("etype") == etype) & (F.col("site_id") == site_id))
    names = [r["feature"] for r in mine.orderBy("rank").select("feature").collect()]
    if not names:
        raise ValueError(f"no selected features for {etype} site {site_id}")
    return names


def write_results_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def write_arrays(samples: DataFrame, path: str) -> None:
    """Array columns, such as window samples or forecast arrays."""
    samples.write.mode("overwrite").parquet(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def violation_rows(shed: DataFrame, ts: str = "ts") -> DataFrame:
    """One entry per stamp with the status and, on a violation, the sites to shed."""
    return shed.select(
        F.date_format(ts, "yyyy-MM-dd HH:mm").alias("_timestamp"),
        F.col("violation").alias("_status"),
        F.when(F.col("violation") & (F.size("shed") > 0), F.struct(F.col("shed").alias("site"))).alias("deload_sites"),
    )


def forecast_rows(predictions: DataFrame, site: str = "site_key", value: str = "p") -> DataFrame:
    """One element per site with its entries in time order, chunked by day so none grows large."""
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("_timestamp"), F.col(value).alias("_VALUE")
    )
    return predictions.groupBy(F.col(site).alias("_name"), F.to_date("ts").alias("_day")).agg(
        F.sort_array(F.collect_list(entry)).alias("entry")
    )


def write_xml(rows: DataFrame, path: str, root: str, row: str) -> None:
    rows.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def write_xml_report(
    consumption: DataFrame, production: DataFrame, shed: DataFrame, path: str
) -> None:
    """The three sections of the report as XML: ``consumption`` and ``production`` with one element
    per site and day, ``violation`` with one per stamp."""
    write_xml(forecast_rows(consumption), f"{path}/consumption", "consumption", "site")
    write_xml(forecast_rows(production), f"{path}/production", "production", "site")
    write_xml(violation_rows(shed), f"{path}/violation", "violation", "entry")
