"""Feature selection by correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline.operators.chunks import ranked_values
from meterline.operators.scaling import _long
from meterline.session import KEY, stored


def feature_counts(df: DataFrame, features: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Distinct and non-null values of each feature, long form."""
    return (
        _long(df, key, features)
        .where(F.col("value").isNotNull())
        .groupBy(*key, "name", "value")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy(*key, "name")
        .agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("_rows").alias("n_values"))
    )


def _paired(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("x")) for c in features]
    )
    return df.select(*key, F.col(f"`{target}`").cast("double").alias("y"), F.inline(pairs)).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )


def _corr(x: str, y: str) -> Column:
    """Correlation; null when one side never changes."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _varies(c: str) -> Column:
    return F.min(c) < F.max(c)


def top_correlated(
    df: DataFrame,
    features: Sequence[str],
    target: str = "ap",
    k: int = 20,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """The ``k`` features with the largest absolute correlation with the target.

    A feature needs two different values and three values; nothing is picked for a target that
    never changes.
    """
    corr = (
        _paired(df, features, target, key)
        .groupBy(*key, "name")
        .agg(
            F.abs(_corr("x", "y")).alias("corr"),
            F.count(F.lit(1)).alias("_n"), _varies("x").alias("_x"), _varies("y").alias("_y"),
        )
        .where("_n > 2 and _x and _y")
    )
    order = Window.partitionBy(*key).orderBy(F.col("corr").desc(), "name")
    return (
        corr.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(*key, "name", "corr", "rank")
    )


def spearman(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: Sequence[str] = KEY,
    complete: bool = False,
) -> DataFrame:
    """Rank correlation of each feature with the target, ties sharing their mean rank.

    Rows with a null on either side are left out feature by feature; ``complete`` says that there
    are none, so that the target is ranked once for all. The ranks come from counts per distinct
    value, so no series is sorted in one task.
    """
    group = [*key, "name"]
    # Pairs that occur more than once are ranked and joined once and weighted by their number.
    counted = stored(
        _paired(df, features, target, key)
        .groupBy(*group, "x", "y")
        .agg(F.count(F.lit(1)).alias("w")),
        "pair-counts",
    )
    first = features[0]

    def ranks(value: str, name: str, by: list[str], rows: DataFrame) -> DataFrame:
        mean_rank = F.col("below") + (F.col("cnt") + 1) / 2
        return ranked_values(rows, by, value, weight="w").select(*by, value, mean_rank.alias(name))

    y_rows, y_key = (counted.where(F.col("name") == first), list(key)) if complete else (counted, group)
    both = counted.join(ranks("x", "rx", group, counted), [*group, "x"]).join(
        ranks("y", "ry", y_key, y_rows), [*y_key, "y"]
    )
    total = F.sum("w")

    def moment(a: str, b: str) -> Column:
        return F.sum(F.col("w") * F.col(a) * F.col(b)) - F.sum(F.col("w") * F.col(a)) * F.sum(
            F.col("w") * F.col(b)
        ) / total

    return both.groupBy(*group).agg(
        F.try_divide(moment("rx", "ry"), F.sqrt(moment("rx", "rx") * moment("ry", "ry"))).alias("rho"),
        total.alias("n"),
    )


def f_scores(
    df: DataFrame, features: Sequence[str], target: str, key: Sequence[str] = KEY
) -> DataFrame:
    """F statistic of the one-feature regression on the target; infinite for an exact fit."""
    r2 = F.pow("r", F.lit(2))
    return (
        _paired(df, features, target, key)
        .groupBy(*key, "name")
        .agg(_corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
        .where(F.col("r").isNotNull())
        .select(
            *key, "name",
            F.when(1 - r2 == 0, F.lit(float("inf")))
            .otherwise(F.try_divide(r2, 1 - r2) * (F.col("n") - 2))
            .alias("f"),
        )
    )


def select_features(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    anchor: str = "ap-0",
    k: int = 13,
    limit: float = 0.1,
    always: str = "t-",
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Out of rows without nulls: features that rank-correlate with ``anchor`` by more than ``limit`` and are among the ``k``
    best F scores for ``target``; names that start with ``always`` are kept in any case."""
    tested = [f for f in features if not f.startswith(always)]
    rho = spearman(df, tested, anchor, key, complete=True).where(F.abs("rho") > limit)
    order = Window.partitionBy(*key).orderBy(F.col("f").desc(), "name")
    best = (
        f_scores(df, tested, target, key)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
    )
    chosen = best.select(*key, "name").intersect(rho.select(*key, "name"))
    kept = [f for f in features if f.startswith(always)]
    if not kept:
        return chosen
    names = F.explode(F.array(*[F.lit(f) for f in kept])).alias("name")
    return chosen.unionByName(df.select(*key).distinct().select(*key, names))
