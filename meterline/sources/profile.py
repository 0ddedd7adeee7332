"""Yearly load profiles as a synthetic demand curve."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from meterline.functions.clock import from_day_number, stamp_text

LEAST_POINTS = 20_000


def profile_times(df: DataFrame, file: Sequence[str] = ("file",)) -> DataFrame:
    """Column ``ts`` of profile rows with ``cet, year, month, day, h, min`` as text or numbers.

    The day number is used; where fewer than half of those of a file are numbers, the file's times
    come from the date columns. What cannot be read is null.
    """
    number = F.col("cet").try_cast("double")
    parts = [F.col(c).try_cast("int") for c in ("year", "month", "day", "h", "min")]
    complete = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    from_parts = F.when(complete, F.try_make_timestamp(*parts, F.lit(0)))
    shares = df.groupBy(*file).agg(F.avg(number.isNotNull().cast("int")).alias("_share"))
    ts = F.when(F.col("_share") < 0.5, from_parts).otherwise(from_day_number(number))
    return df.join(shares, list(file)).withColumn("ts", ts).drop("_share")


def choose_column(
    cells: DataFrame,
    target: str,
    fallback: str,
    file: Sequence[str] = ("file",),
    head: int = 4,
) -> DataFrame:
    """Column of each file for an operator, of long cells ``col_pos, col_name, row_pos, cell``.

    In this order: a column named as the target, one with the target in its first rows, one named as
    the fallback, one whose name starts with the fallback; the leftmost of several. A file without
    any is an error.
    """
    target, fallback = target.strip().lower(), fallback.strip().lower()
    labelled = (F.col("row_pos") < head) & (F.lower(F.trim("cell")) == target)
    columns = cells.groupBy(*file, "col_pos", F.trim("col_name").alias("col_name")).agg(
        F.coalesce(F.bool_or(labelled), F.lit(False)).alias("_labelled")
    )
    name = F.lower("col_name")
    rank = (
        F.when(name == target, 1)
        .when(F.col("_labelled"), 2)
        .when(name == fallback, 3)
        .when(name.startswith(fallback), 4)
    )
    best = (
        columns.withColumn("_rank", rank)
        .groupBy(*file)
        .agg(
            F.min_by(
                F.struct("col_pos", "col_name", F.col("_rank").alias("rule")),
                F.when(F.col("_rank").isNotNull(), F.struct("_rank", "col_pos")),
            ).alias("_best")
        )
    )
    message = F.lit(f"no column for operator {target}")
    return best.select(
        *file, "_best.col_pos",
        F.when(F.col("_best").isNull(), F.raise_error(message)).otherwise(F.col("_best.col_name")).alias("col_name"),
        "_best.rule",
    )


def clean_profile(
    df: DataFrame,
    file: Sequence[str] = ("file",),
    order: Sequence[str] = (),
    least: int = LEAST_POINTS,
    on_short: str = "error",
) -> DataFrame:
    """Points with a time between 2000 and 2100 and a value, one per time, the first by ``order``.

    A file with fewer than ``least`` points is an error, or left out with ``on_short='drop'``.
    """
    if on_short not in ("error", "drop"):
        raise ValueError(f"on_short is 'error' or 'drop', not {on_short!r}")
    valid = df.where("ts is not null and value is not null").where(F.year("ts").between(2000, 2100))
    first = F.min_by("value", F.struct(*order)) if order else F.first("value")
    points = valid.groupBy(*file, "ts").agg(first.alias("value"))
    sizes = points.groupBy(*file).agg(F.count(F.lit(1)).alias("_points"))
    joined = points.join(sizes, list(file))
    if on_short == "drop":
        return joined.where(F.col("_points") >= least).drop("_points")
    message = F.concat(F.lit("too few points: "), F.col("_points").cast("string"))
    checked = F.when(F.col("_points") < least, F.raise_error(message)).otherwise(F.col("value"))
    return joined.withColumn("value", checked).drop("_points")


def to_watts(
    df: DataFrame,
    annual_kwh: float = 3500.0,
    minutes: int = 15,
    file: Sequence[str] = ("year",),
) -> DataFrame:
    """Column ``power_w``. The sum and maximum of a file tell its unit: shares of the year (sum near
    1), percent (near 100), kilowatts (all below 50), else watts."""
    value = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    totals = df.groupBy(*file).agg(F.sum(value).alias("_sum"), F.max(value).alias("_max"))
    total = F.col("_sum")
    hours = minutes / 60.0

    def of_share(share: Column) -> Column:
        return F.lit(annual_kwh) * share / hours * 1000.0

    power = (
        F.when(total.between(0.8, 1.2), of_share(value))
        .when(total.between(80.0, 120.0), of_share(value / 100.0))
        .when(F.col("_max") < 50, value * 1000.0)
        .otherwise(value)
    )
    return df.join(totals, list(file)).withColumn("power_w", power).drop("_sum", "_max")


def demand_curve(parts: Sequence[DataFrame]) -> DataFrame:
    """All years as one curve ``ts, power_w, year`` in time order, stamps as text."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.select("ts", "power_w", "year") for p in parts])
    ordered = rows.where("ts is not null and power_w is not null").orderBy("ts")
    return ordered.withColumn("ts", stamp_text(F.col("ts")))


def write_demand(curve: DataFrame, path: str) -> None:
    curve.write.mode("overwrite").option("header", True).csv(path)
