"""The driver tables seen as readings, weather, profiles and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterline.functions.clock import floor_to
from meterline.operators.features import feature_matrix
from meterline.operators.regular import first_in_bin, join_weather, resample
from meterline.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; naive stamps become instants in UTC."""
    df = use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns(
        {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    )


def naive_stamps(df: DataFrame) -> DataFrame:
    """Instants back to naive stamps, which is what the inputs hold."""
    return df.withColumns(
        {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"}
    )


def etype_of(event_type: Column) -> Column:
    return F.when(event_type.isin("purchase", "error"), "production").otherwise("consumption")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as meter readings of seven sites and two energy types."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        etype_of(F.col("event_type")).alias("etype"),
        (F.col("user_id") % 7 + 1).cast("int").alias("site_id"),
        F.col("user_id").alias("sn"),
        F.col("ts").alias("dls"),
        F.col("value").alias("ap"),
        F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("double").alias("q1"),
        F.lit(0.0).alias("q4"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute totals of ``ap`` on the full grid, to six places."""
    totals = resample(readings(spark, sf_dir), sums=["ap"])
    return totals.withColumn("ap", F.round("ap", 6))


def weather10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events as 10-minute weather: mean as temperature, largest as sun."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.groupBy(floor_to(F.col("ts"), 600).alias("ts")).agg(
        F.round(F.avg("value"), 6).alias("temp"), F.max("value").alias("sun")
    )


def weather15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_in_bin(weather10(spark, sf_dir), ["temp", "sun"])


def regular_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with filled weather."""
    return join_weather(grid(spark, sf_dir), weather15(spark, sf_dir))


def matrix(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Feature matrix of the grid with weather, calendar and statistics."""
    return feature_matrix(
        grid(spark, sf_dir), weather15(spark, sf_dir), regular=True, **options
    )
