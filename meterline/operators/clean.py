"""Row filters and value clean-up on readings and series."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from meterline.functions.clock import cutoff
from meterline.functions.names import normal_site
from meterline.session import KEY


def abs_production(
    df: DataFrame, cols: Iterable[str] = ("ap", "q1", "q4"), production: str = "production"
) -> DataFrame:
    """Production is stored negative: turn it round where the ``production`` column is true."""
    return df.withColumns(
        {c: F.when(F.col(production), F.abs(F.col(c))).otherwise(F.col(c)) for c in cols}
    )


def drop_all_zero(df: DataFrame, cols: Iterable[str] = ("ap", "q1", "q4")) -> DataFrame:
    """Drop rows where every column is 0; a null is not 0."""
    some = F.lit(False)
    for c in cols:
        some = some | F.coalesce(F.col(c) != 0, F.lit(True))
    return df.where(some)


def typed_readings(df: DataFrame) -> DataFrame:
    """Normalised site name, whole serial number, event time under the name ``ts``."""
    return (
        df.withColumn("site", normal_site(F.col("site")))
        .withColumn("sn", F.col("sn").cast("long"))
        .withColumnRenamed("dls", "ts")
    )


def drop_reactive(df: DataFrame) -> DataFrame:
    return df.drop("q1", "q4")


def drop_periods(
    df: DataFrame, periods: DataFrame, key: Sequence[str] = KEY, ts: str = "ts"
) -> DataFrame:
    """Drop the rows inside a period of their key, both ends included.

    ``periods`` holds the key, ``start_ts`` and ``end_ts``; a null end is open. Ends given as dates
    are midnights, so the last day keeps all but its first step.
    """
    row, gap = df.alias("row"), periods.alias("gap")
    inside = F.lit(True)
    for c in key:
        inside = inside & (F.col(f"row.{c}") == F.col(f"gap.{c}"))
    stamp = F.col(f"row.{ts}")
    inside = (
        inside
        & (stamp >= F.coalesce("gap.start_ts", stamp))
        & (stamp <= F.coalesce("gap.end_ts", stamp))
    )
    return row.join(gap, inside, "left_anti")


def only_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(listed.select(*on), list(on), "left_semi")


def not_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(listed.select(*on), list(on), "left_anti")


def listed_sites(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Distinct ``(site, sn)`` without the empty user; kept when the normalised pair is allowed."""
    users = df.select("site", "sn").distinct().where(~((F.col("site") == "") & (F.col("sn") == 0)))
    pairs = allowed.select(
        normal_site(F.col("site")).alias("_site"), F.col("sn").cast("string").alias("_sn")
    )
    return (
        users.withColumn("_site", normal_site(F.col("site")))
        .withColumn("_sn", F.col("sn").cast("string"))
        .join(pairs, ["_site", "_sn"], "left_semi")
        .select("site", "sn")
    )


def series_sizes(
    df: DataFrame, key: Sequence[str] = KEY, ratios: Sequence[float] = (0.8, 0.1, 0.1)
) -> DataFrame:
    """Length of each series and of its truncated train, validation and test blocks."""
    n = F.col("n")
    train, val, test = ratios
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(
        *key, "n",
        F.floor(n * F.lit(train)).alias("train_rows"),
        F.floor(n * F.lit(val)).alias("val_rows"),
        F.floor(n * F.lit(test)).alias("test_rows"),
    )


def long_enough(df: DataFrame, min_length: int, key: Sequence[str] = KEY) -> DataFrame:
    """Drop the series whose length, train block or validation block is under ``min_length``."""
    kept = series_sizes(df, key).where(F.least("n", "train_rows", "val_rows") >= min_length)
    return df.join(kept.select(*key), list(key), "left_semi")


def known_until(df: DataFrame, now, delay_days: int, ts: str = "ts") -> DataFrame:
    """Rows known at ``now`` when the data arrive ``delay_days`` late."""
    return df.where(F.col(ts) <= cutoff(F.lit(now).cast("timestamp"), delay_days))


def latest(df: DataFrame, key: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """Last row of each key, by an aggregate that keeps one row per key and task."""
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    return df.groupBy(*key).agg(F.max_by(row, F.col(ts)).alias("_row")).select(
        *key, *[F.col(f"_row.`{c}`").alias(c) for c in rest]
    )


def last_rows(df: DataFrame, n: int = 96, key: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """Last ``n`` rows of each key; Spark cuts each task to ``n`` rows a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(ts).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
