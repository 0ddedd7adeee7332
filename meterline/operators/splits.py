"""Splits and folds by position in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterline.operators.chunks import with_position
from meterline.session import KEY


def _rows(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(ratio)).cast("long")


def ratio_split(
    df: DataFrame,
    key: Sequence[str] = KEY,
    ts: str = "ts",
    ratios: Sequence[float] = (0.8, 0.1, 0.1),
    mode: str = "sizes",
) -> DataFrame:
    """Column ``split`` with ``train``, ``val``, ``test``, or null for rows in no block.

    ``sizes`` truncates the three block lengths, the test block being the last rows; ``cuts``
    cuts at the truncated 80 and 90 percent positions and leaves no row out.
    """
    if mode not in ("sizes", "cuts"):
        raise ValueError(f"mode is 'sizes' or 'cuts', not {mode!r}")
    train, val, test = ratios
    numbered = with_position(df, key, ts)
    pos, n = F.col("pos"), F.col("n")
    if mode == "sizes":
        train_rows, val_rows, test_rows = _rows(n, train), _rows(n, val), _rows(n, test)
        part = (
            F.when(pos < train_rows, "train")
            .when(pos < train_rows + val_rows, "val")
            .when(pos >= n - test_rows, "test")
        )
    else:
        # The second cut is the share that is not test, as one number.
        part = (
            F.when(pos < _rows(n, train), "train")
            .when(pos < _rows(n, round(1 - test, 12)), "val")
            .otherwise("test")
        )
    return numbered.withColumn("split", part).drop("pos", "n")


def split_bounds(split: DataFrame, key: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """First and last stamp and row count of each block."""
    return (
        split.where(F.col("split").isNotNull())
        .groupBy(*key, "split")
        .agg(F.min(ts).alias("start"), F.max(ts).alias("stop"), F.count(F.lit(1)).alias("n"))
    )


def held_out(
    df: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", share: float = 0.9
) -> DataFrame:
    """Rows from the truncated 90 percent position on."""
    return with_position(df, key, ts).where(F.col("pos") >= _rows(F.col("n"), share)).drop("pos", "n")


def kfold(
    df: DataFrame,
    k: int = 10,
    key: Sequence[str] = KEY,
    ts: str = "ts",
    ratios: Sequence[float] = (0.8, 0.1, 0.1),
    cap_at_test: bool = False,
) -> DataFrame:
    """One row per row and fold it belongs to: ``fold`` 0..k-1 and ``part`` train or val.

    Fold i trains on the first i+1 blocks of ``(train+val)/k`` rows and validates on the next one;
    the last fold validates on test rows unless ``cap_at_test``. The folds of a row follow from
    its block, so only pairs that exist are made.
    """
    numbered = with_position(df, key, ts)
    n = F.col("n")
    size = F.floor((_rows(n, ratios[0]) + _rows(n, ratios[1])) / k)
    block = F.floor(F.try_divide(F.col("pos"), size))
    last = F.lit(k - 1) if cap_at_test else F.lit(k)
    rows = numbered.withColumn("_block", block.cast("long")).where(F.col("_block") <= last)
    first_fold = F.greatest(F.col("_block") - 1, F.lit(0))
    folds = rows.withColumn("fold", F.explode(F.sequence(first_fold, F.lit(k - 1).cast("long"))))
    if cap_at_test:
        folds = folds.where(F.col("fold") < k - 1)
    part = F.when(F.col("fold") >= F.col("_block"), "train").otherwise("val")
    return folds.withColumn("part", part).drop("pos", "n", "_block")


def kfold_bounds(
    df: DataFrame,
    k: int = 10,
    key: Sequence[str] = KEY,
    ts: str = "ts",
    ratios: Sequence[float] = (0.8, 0.1, 0.1),
) -> DataFrame:
    """First and last stamp of the train and validation block of each fold.

    Bounds are taken per block of rows first, so the rows are never repeated per fold.
    """
    numbered = with_position(df, key, ts)
    n = F.col("n")
    size = F.floor((_rows(n, ratios[0]) + _rows(n, ratios[1])) / k)
    blocks = (
        numbered.withColumn("_block", F.floor(F.try_divide(F.col("pos"), size)).cast("long"))
        .where(F.col("_block") <= k)
        .groupBy(*key, "_block")
        .agg(F.min(ts).alias("_start"), F.max(ts).alias("_stop"), F.count(F.lit(1)).alias("_rows"))
    )
    folds = blocks.withColumn(
        "fold",
        F.explode(F.sequence(F.greatest(F.col("_block") - 1, F.lit(0)), F.lit(k - 1).cast("long"))),
    ).withColumn("part", F.when(F.col("fold") >= F.col("_block"), "train").otherwise("val"))
    return folds.groupBy(*key, "fold", "part").agg(
        F.min("_start").alias("start"), F.max("_stop").alias("stop"), F.sum("_rows").alias("n")
    )


def expanding_folds(
    df: DataFrame, size: int, key: Sequence[str] = KEY, ts: str = "ts"
) -> DataFrame:
    """Folds 0, 1, ... validating on the next ``size`` rows after those trained on, the last one on
    what is left: columns ``fold`` and ``part``."""
    numbered = with_position(df, key, ts)
    block = F.floor(F.col("pos") / size).cast("long")
    last_fold = (F.ceil(F.col("n") / size) - 2).cast("long")
    first_fold = F.greatest(block - 1, F.lit(0))
    rows = numbered.where(last_fold >= first_fold).withColumn(
        "fold", F.explode(F.sequence(first_fold, last_fold))
    )
    part = F.when(F.col("fold") >= block, "train").otherwise("val")
    return rows.withColumn("part", part).drop("pos", "n")
