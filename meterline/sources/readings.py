"""Raw reading files and the store of regular series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from meterline.functions.names import parse_file_name, site_key
from meterline.operators.clean import abs_production, drop_all_zero
from meterline.operators.regular import resample

READING_SCHEMA = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("sn", T.LongType()),
        T.StructField("dls", T.TimestampType()),
        T.StructField("ap", T.DoubleType()),
        T.StructField("q1", T.DoubleType()),
        T.StructField("q4", T.DoubleType()),
    ]
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All reading files under a path in one scan, with the ``file`` each row comes from."""
    rows = spark.read.schema(READING_SCHEMA).option("header", True).csv(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def files_with_rows(df: DataFrame, file: str = "file", least: int = 2) -> DataFrame:
    """Rows of the files that hold at least ``least`` rows; a shorter file has no data."""
    full = df.groupBy(file).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least)
    return df.join(full.select(file), file, "left_semi")


def keyed(
    df: DataFrame,
    file: Column | None = None,
    always_production: Iterable[tuple[str, str]] = (),
    prefix: str = "site",
) -> DataFrame:
    """Energy type, production flag and site key of each row, from its file name."""
    parsed = parse_file_name(F.col("file") if file is None else file, always_production)
    named = df.withColumn("_parsed", parsed)
    return named.select(
        *df.columns,
        F.col("_parsed.production").alias("production"),
        F.when(F.col("_parsed.production"), "production").otherwise("consumption").alias("etype"),
        site_key(
            F.col("_parsed.site"), F.col("_parsed.sn"), F.col("_parsed.production"), prefix
        ).alias("site_key"),
    )


def ingest(
    rows: DataFrame,
    allowed: DataFrame | None = None,
    dedupe: bool = False,
    always_production: Iterable[tuple[str, str]] = (),
    prefix: str = "site",
) -> DataFrame:
    """Raw rows with a ``file`` column to regular series ``etype, site_key, ts, ap, q1, q4``.

    Files of one site key add up, also when a reading is in two of them; ``dedupe`` keeps one row per
    key and event time. ``allowed`` (column ``site_key``) restricts the keys.
    """
    named = keyed(files_with_rows(rows), always_production=always_production, prefix=prefix)
    if allowed is not None:
        named = named.join(allowed.select("site_key"), "site_key", "left_semi")
    if dedupe:
        row = F.struct("ap", "q1", "q4")
        named = (
            named.groupBy("etype", "site_key", "production", "dls")
            .agg(F.min_by(row, F.col("file")).alias("_row"))
            .select("etype", "site_key", "production", "dls", "_row.*")
        )
    return resample(drop_all_zero(abs_production(named)), ["etype", "site_key"])


def write_series(series: DataFrame, path: str) -> None:
    """Store series by energy type and key; a key written again replaces the one before."""
    (
        series.repartition("etype", "site_key", F.year("ts"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("etype", "site_key")
        .parquet(path)
    )


def read_series(spark: SparkSession, path: str, site_key: str | None = None) -> DataFrame:
    """Stored series; a key reads only its own partition."""
    series = spark.read.parquet(path)
    return series if site_key is None else series.where(F.col("site_key") == site_key)
