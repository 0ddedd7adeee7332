"""Scaling of features and targets per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from meterline.operators.chunks import exact_quantiles
from meterline.session import KEY


def _long(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols]
    )
    return df.select(*key, F.inline(pairs))


def robust_parameters(
    df: DataFrame, cols: Sequence[str], key: Sequence[str] = KEY, where: str | None = None
) -> DataFrame:
    """Exact median and interquartile range of each column of each series, long form.

    A range of 0 counts as 1. By default all rows are used; ``where`` restricts the fit, for
    example to the train rows.
    """
    fit = df.where(where) if where else df
    probs = {"_q1": 0.25, "center": 0.5, "_q3": 0.75}
    spread = F.col("_q3") - F.col("_q1")
    return exact_quantiles(_long(fit, key, cols), [*key, "name"], "value", probs).select(
        *key, "name", "center", F.when(spread == 0, 1.0).otherwise(spread).alias("scale")
    )


def standard_parameters(
    df: DataFrame,
    cols: Sequence[str],
    key: Sequence[str] = KEY,
    where: str | None = None,
    sample: bool = False,
) -> DataFrame:
    """Mean and standard deviation, of the population unless ``sample``; 0 counts as 1."""
    fit = df.where(where) if where else df
    std = F.stddev_samp("value") if sample else F.stddev_pop("value")
    return (
        _long(fit, key, cols)
        .groupBy(*key, "name")
        .agg(F.avg("value").alias("center"), std.alias("_std"))
        .select(
            *key, "name", "center", F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std")).alias("scale")
        )
    )


def _joined(df: DataFrame, parameters: DataFrame, key: Sequence[str]) -> DataFrame:
    """One map of scalers per series, joined to its rows."""
    entry = F.struct("name", F.struct("center", "scale"))
    scalers = parameters.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("_scaler"))
    return df.join(scalers, list(key), "left")


def scale(
    df: DataFrame, parameters: DataFrame, cols: Sequence[str], key: Sequence[str] = KEY
) -> DataFrame:
    at = lambda c: F.col("_scaler")[c]
    return _joined(df, parameters, key).select(
        *[
            ((F.col(f"`{c}`") - at(c)["center"]) / at(c)["scale"]).alias(c)
            if c in cols else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def unscale(
    df: DataFrame,
    parameters: DataFrame,
    cols: Sequence[str],
    key: Sequence[str] = KEY,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Undo ``scale``; ``names`` tells which scaler a column uses (a prediction uses its target's)."""
    names = names or {}
    at = lambda c: F.col("_scaler")[names.get(c, c)]
    return _joined(df, parameters, key).select(
        *[
            (F.col(f"`{c}`") * at(c)["scale"] + at(c)["center"]).alias(c)
            if c in cols else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
