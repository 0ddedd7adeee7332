"""Weather observations of one station."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meterline.operators.regular import first_in_bin

# Weather columns in feature order.
WEATHER_COLUMNS = [
    "precip_quantity", "temp_dry_shelter_avg", "temp_grass_pt100_avg", "temp_soil_avg",
    "temp_soil_avg_5cm", "temp_soil_avg_10cm", "temp_soil_avg_20cm", "temp_soil_avg_50cm",
    "wind_speed_10m", "wind_speed_avg_30m", "wind_direction", "wind_gusts_speed",
    "humidity_rel_shelter_avg", "pressure", "sun_duration", "short_wave_from_sky_avg",
    "sun_int_avg",
]


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """10-minute observations from CSV files with a header, one or many years under a path.

    Columns are taken by name, so files may hold more of them in any order.
    """
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col("timestamp").try_cast("timestamp").alias("ts"),
        *[F.col(c).try_cast("double").alias(c) for c in WEATHER_COLUMNS],
    ).where(F.col("ts").isNotNull())


def write_weather(df: DataFrame, path: str) -> None:
    """Append observations to the CSV folder of their year."""
    df.withColumn("year", F.year("ts")).withColumnRenamed("ts", "timestamp").write.mode(
        "append"
    ).partitionBy("year").option("header", True).csv(path)


def of_station(df: DataFrame, stations: DataFrame, name: str, place: str = "the_geom") -> DataFrame:
    """Observations at the place of the named station."""
    return df.join(stations.where(F.col("name") == name).select(place), place, "left_semi")


def weather_grid(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """15-minute weather: first known value of each step."""
    return first_in_bin(df, cols or [c for c in df.columns if c != "ts"])


def schema() -> T.StructType:
    return T.StructType(
        [T.StructField("timestamp", T.TimestampType())]
        + [T.StructField(c, T.DoubleType()) for c in WEATHER_COLUMNS]
    )
