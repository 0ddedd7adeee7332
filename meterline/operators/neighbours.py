"""Exact nearest-neighbour regression without comparing all pairs.

Points are ordered within their series by their mean feature value times the root of the number of
features, which is the length of their projection on the diagonal. What is left of a point's length
is its distance from the diagonal; two points are never closer than these two numbers say. Train
and test rows are cut into blocks of neighbours in that order. The blocks next to a test block give
each of its rows a first bound on the distance of its k-th neighbour; then a row goes only to those
train blocks that come within its own bound and were not searched yet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from meterline.session import KEY, checkpointed

BLOCK_ROWS = 2048
# Differences held at once while distances are computed.
DISTANCE_VALUES = 4_000_000


def _blocked(df: DataFrame, features: Sequence[str], key: Sequence[str], rows: int) -> DataFrame:
    """Rows with ``vec``, ``proj``, ``away`` and the ``block`` of at most ``rows`` neighbours they are in.

    The rows are range-partitioned by series and projection, so a large series is spread over many
    tasks; a block never crosses a partition or a series. The result is written out, for the block
    numbers must not change when a lost task is run again.
    """
    vec = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.withColumn("vec", vec)
        .withColumn("proj", total / math.sqrt(len(features)))
        .withColumn("away", F.sqrt(F.greatest(square - F.col("proj") * F.col("proj"), F.lit(0.0))))
        .drop(*[c for c in features])
        .repartitionByRange(parts, *key, "proj")
        .sortWithinPartitions(*key, "proj")
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # Consecutive numbers inside a partition; a block is a run of them within one series.
    block = F.struct(
        F.shiftright("_id", 33).alias("part"),
        F.floor(F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) / rows).alias("run"),
    )
    written = checkpointed(placed.withColumn("block", block).drop("_id"))
    # Columns of their own, for train and test often are parts of one frame.
    return written.select(*[F.col(f"`{c}`").alias(c) for c in written.columns])


def _block_ranges(blocked: DataFrame, key: Sequence[str]) -> DataFrame:
    return blocked.groupBy(*key, "block").agg(
        F.min("proj").alias("lo"), F.max("proj").alias("hi"),
        F.min("away").alias("near"), F.max("away").alias("far"),
    )


def _home_blocks(test: DataFrame, train: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per test block, the train blocks that start last before its middle, and those around them."""
    order = Window.partitionBy(*key).orderBy("lo", "block")
    chain = train.select(
        *key, "lo", "block",
        F.array_compact(
            F.array(F.lag("block").over(order), F.col("block"), F.lead("block").over(order))
        ).alias("homes"),
    )
    marks = chain.select(*key, F.col("lo").alias("_at"), "homes", F.lit(None).alias("_test")).unionByName(
        test.select(
            *key, ((F.col("lo") + F.col("hi")) / 2).alias("_at"),
            F.lit(None).cast(chain.schema["homes"].dataType).alias("homes"),
            F.col("block").alias("_test"),
        )
    )
    line = Window.partitionBy(*key).orderBy("_at", F.col("homes").isNull())
    before = line.rowsBetween(Window.unboundedPreceding, 0)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    return (
        marks.select(
            *key, "_test",
            F.coalesce(
                F.last("homes", ignorenulls=True).over(before),
                F.first("homes", ignorenulls=True).over(after),
            ).alias("homes"),
        )
        .where("_test is not null and homes is not null")
        .select(*key, F.col("_test").alias("test_block"), F.explode("homes").alias("train_block"))
    )


def _search(
    test: DataFrame, train: DataFrame, key: Sequence[str], ts: str, k: int
) -> DataFrame:
    """The ``k`` nearest train rows of each test row: key, ``ts``, ``dist``, ``y``.

    ``test`` has a row per test row and ``train_block`` to search. One task call sees one test block
    and one train block, both of bounded size, and gives back at most ``k`` rows per test row; the
    lists of the blocks of a test row are merged after.
    """
    row, group = [*key, ts], [*key, "test_block", "train_block"]
    left = test.withColumnRenamed("block", "test_block").select(*group, ts, "vec")
    pairs = left.select(*group).distinct()
    right = train.withColumnRenamed("block", "train_block").join(pairs, [*key, "train_block"])
    right = right.select(*[F.col(f"`{c}`").alias(c) for c in [*group, "vec", "y"]])

    def nearest(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        if near.empty or far.empty:
            return near[row].head(0).assign(dist=0.0, y=0.0)
        a, b = np.stack(near["vec"].to_numpy()), np.stack(far["vec"].to_numpy())
        y = far["y"].to_numpy()
        keep = min(k, len(b))
        step = max(1, DISTANCE_VALUES // b.size)
        picks, dists = [], []
        for at in range(0, len(a), step):
            dist = np.sqrt(((b[None] - a[at: at + step, None]) ** 2).sum(axis=2))
            # The order of equals is by value, so that it does not depend on the blocks.
            pick = np.lexsort((np.broadcast_to(y, dist.shape), dist), axis=1)[:, :keep]
            picks.append(pick.ravel())
            dists.append(np.take_along_axis(dist, pick, axis=1).ravel())
        out = near[row].loc[near.index.repeat(keep)].reset_index(drop=True)
        return out.assign(dist=np.concatenate(dists), y=y[np.concatenate(picks)])

    schema = T.StructType(
        [
            *left.select(*row).schema.fields,
            T.StructField("dist", T.DoubleType()),
            T.StructField("y", T.DoubleType()),
        ]
    )
    found = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInPandas(nearest, schema)
    )
    return _best(found, row, k)


def _best(found: DataFrame, row: Sequence[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*row).orderBy("dist", "y"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _gap(low: str, high: str, at: str) -> Column:
    """How far ``at`` lies outside ``low`` to ``high``."""
    return F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0))


def probes(
    near: DataFrame, first: DataFrame, homes: DataFrame, far_ranges: DataFrame,
    key: Sequence[str], ts: str, k: int,
) -> DataFrame:
    """Test rows with each ``train_block`` that may hold one of their ``k`` nearest and was not searched."""
    row = [*key, ts]
    # Distance of the k-th neighbour so far; without k of them nothing is ruled out.
    bound = first.groupBy(*row).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("reach")
    )
    # Rounding must not rule a neighbour out.
    reach = F.coalesce("reach", F.lit(float("inf"))) * (1 + 1e-9) + 1e-9 * (1 + F.abs("proj") + F.col("away"))
    reaching = near.join(bound, row, "left").withColumn("reach", reach)
    widest = reaching.groupBy(*key, "block").agg(
        F.min(F.col("proj") - F.col("reach")).alias("_from"), F.max(F.col("proj") + F.col("reach")).alias("_to")
    )
    pairs = (
        widest.withColumnRenamed("block", "test_block")
        .join(far_ranges.withColumnRenamed("block", "train_block"), list(key))
        .where((F.col("hi") >= F.col("_from")) & (F.col("lo") <= F.col("_to")))
        .select(*key, "test_block", "train_block", "lo", "hi", "near", "far")
        .join(homes, [*key, "test_block", "train_block"], "left_anti")
    )
    along, aside = _gap("lo", "hi", "proj"), _gap("near", "far", "away")
    return (
        reaching.withColumnRenamed("block", "test_block")
        .join(pairs, [*key, "test_block"])
        .where(along * along + aside * aside <= F.col("reach") * F.col("reach"))
        .select(*key, F.col("test_block").alias("block"), "train_block", ts, "vec")
    )


def knn(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    k: int = 50,
    key: Sequence[str] = KEY,
    ts: str = "ts",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the ``k`` nearest train labels of the same series, weighted by inverse distance.

    Where a distance is 0, only the rows at distance 0 count. Result: key, ``ts`` and ``p``, one row
    per key and ``ts`` of ``test``, which are unique. Equal distances at the border of the ``k`` are
    taken by ascending label.
    """
    key = list(key)
    row = [*key, ts]
    near = _blocked(test.select(*row, *features), features, key, block_rows)
    far = _blocked(
        train.select(*key, *features, F.col(f"`{label}`").cast("double").alias("y")),
        features, key, max(block_rows, k),
    )
    near_ranges, far_ranges = _block_ranges(near, key), _block_ranges(far, key)
    homes = checkpointed(_home_blocks(near_ranges, far_ranges, key))
    at_home = near.join(homes.withColumnRenamed("test_block", "block"), [*key, "block"])
    first = checkpointed(_search(at_home, far, key, ts, k))
    more = _search(checkpointed(probes(near, first, homes, far_ranges, key, ts, k)), far, key, ts, k)
    best = _best(first.unionByName(more), row, k)
    weight = 1 / F.col("dist")
    return best.groupBy(*row).agg(
        F.avg(F.when(F.col("dist") == 0, F.col("y"))).alias("_same"),
        (
            F.sum(F.when(F.col("dist") > 0, F.col("y") * weight))
            / F.sum(F.when(F.col("dist") > 0, weight))
        ).alias("_near"),
    ).select(*row, F.coalesce("_same", "_near").alias("p"))
