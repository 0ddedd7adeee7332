"""Error measures by group, over folds, and over overlapping forecasts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterline.functions.errors import (
    MACHINE_EPSILON, accuracy, agreement_percent, error_above_percent, mae, mape_percent,
    mean_squared, modified_smape_percent, r2, smape_percent, wmape_percent,
)
from meterline.session import KEY

MEASURES = ["mae", "nmae", "mape", "mse", "rmse", "nrmse", "r2"]


def metrics(df: DataFrame, by: Sequence[str] = KEY, y: str = "y", p: str = "p") -> DataFrame:
    """The seven standard measures and the row count of each group."""
    values = accuracy(F.col(y), F.col(p))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in values.items()]
    )


def mean_over_outputs(per_output: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Measures of several outputs as one: plain mean of the per-output errors, the root taken per
    mean square and the normalised ones divided by the mean of all outputs."""
    mean = F.try_divide(F.sum(F.try_divide("mae", "nmae") * F.col("n")), F.sum("n"))
    return per_output.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.avg("mae").alias("mae"),
        F.try_divide(F.avg("mae"), mean).alias("nmae"),
        F.avg("mape").alias("mape"),
        F.avg("mse").alias("mse"),
        F.sqrt(F.avg("mse")).alias("rmse"),
        F.try_divide(F.sqrt(F.avg("mse")), mean).alias("nrmse"),
        F.avg("r2").alias("r2"),
    )


def older_metrics(df: DataFrame, by: Sequence[str] = KEY, y: str = "y", p: str = "p") -> DataFrame:
    """The measures of the earlier generation of the toolkit, one column each."""
    a, b = F.col(y), F.col(p)
    means = df.groupBy(*by).agg(F.avg(a).alias("_mean"))
    return (
        df.join(means, list(by))
        .groupBy(*by)
        .agg(
            mae(a, b).alias("mae"),
            mape_percent(a, b).alias("mape_percent"),
            smape_percent(a, b).alias("smape_percent"),
            modified_smape_percent(a, b).alias("modified_smape_percent"),
            wmape_percent(a, b).alias("wmape_percent"),
            mean_squared(a, b, squared=False).alias("mse"),
            mean_squared(a, b).alias("rmse"),
            r2(a, b).alias("r2"),
            agreement_percent(a, b, F.col("_mean")).alias("agreement_percent"),
            error_above_percent(a, b).alias("error_above_percent"),
        )
    )


def metrics_cube(
    df: DataFrame,
    fold: str = "fold",
    sites: Sequence[str] = KEY,
    target: str = "target",
    y: str = "y_true",
    p: str = "y_pred",
) -> DataFrame:
    """Measures per fold for all rows, per site, per target, and per site and target.

    The rows are reduced once to sums per fold, site and target; the grouping sets run over those
    few rows. A null site or target stands for all.
    """
    error = F.abs(F.col(y) - F.col(p))
    relative = error / F.greatest(F.abs(F.col(y)), F.lit(MACHINE_EPSILON))
    cells = df.groupBy(fold, *sites, target).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(error).alias("_abs"),
        F.sum(error * error).alias("_sq"),
        F.sum(relative).alias("_rel"),
        F.sum(y).alias("_y"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_dev"),
    )
    n = F.sum("_n")
    mean = F.sum("_y") / n
    # Deviation from the common mean: inside the cells plus between the cell means.
    dev = F.sum("_dev") + F.sum(F.col("_y") * F.col("_y") / F.col("_n")) - F.sum("_y") * mean
    squares = F.sum("_sq")
    exact = F.when(squares == 0, 1.0).otherwise(0.0)
    keys = [F.col(fold), *[F.col(c) for c in sites], F.col(target)]
    sets = [[keys[0]], keys[:-1], [keys[0], keys[-1]], keys]
    return cells.groupingSets(sets, *keys).agg(
        n.alias("n"),
        (F.sum("_abs") / n).alias("mae"),
        F.try_divide(F.sum("_abs"), F.sum("_y")).alias("nmae"),
        (F.sum("_rel") / n).alias("mape"),
        (squares / n).alias("mse"),
        F.sqrt(squares / n).alias("rmse"),
        F.try_divide(F.sqrt(squares / n), mean).alias("nrmse"),
        F.when(dev == 0, exact).otherwise(1 - F.try_divide(squares, dev)).alias("r2"),
    )


def mean_over_folds(
    cube: DataFrame, sites: Sequence[str] = KEY, target: str = "target"
) -> DataFrame:
    """Mean of each measure over the folds, per site and target of the cube."""
    return cube.groupBy(*sites, target).agg(
        F.count(F.lit(1)).alias("n_folds"), *[F.avg(m).alias(m) for m in MEASURES if m != "r2"]
    )


def best_fold(
    cube: DataFrame, fold: str = "fold", sites: Sequence[str] = KEY, target: str = "target"
) -> DataFrame:
    """Fold with the smallest overall MAE, the earliest of equals."""
    overall = F.col(target).isNull()
    for c in sites:
        overall = overall & F.col(c).isNull()
    return cube.where(overall).agg(
        F.min_by(fold, F.struct("mae", fold)).alias("best_fold"), F.min("mae").alias("best_mae")
    )


def t_quantile(df: int, prob: float = 0.975) -> float:
    """Quantile of Student's t, by bisection on Simpson's rule over the density."""
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    # With t = sqrt(df) * tan(a) the integral runs over a bounded angle.
    density = lambda a: front * math.sqrt(df) * math.cos(a) ** (df - 1)

    def below(angle: float, parts: int = 400) -> float:
        h = angle / parts
        inner = sum((4 if i % 2 else 2) * density(i * h) for i in range(1, parts))
        return 0.5 + h / 3 * (density(0.0) + inner + density(angle))

    lo, hi = 0.0, math.pi / 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < prob else (lo, mid)
    return math.sqrt(df) * math.tan((lo + hi) / 2)


def overlap_ensemble(
    df: DataFrame,
    key: Sequence[str] = KEY,
    origin: str = "pos",
    forecasts: str = "pred",
    y: str = "y",
    bounds: str = "iqr",
    horizon: int | None = None,
) -> DataFrame:
    """Merge the forecasts that several origins made for one step.

    Each row is an origin with the true value ``y`` of its first step and an array of forecasts for
    the steps from there on. A step holds at most ``horizon`` forecasts. ``iqr`` bounds are the
    mean -/+ 1.5 interquartile ranges; ``t`` bounds the 95 percent interval of the mean, which a
    step with one forecast does not have, so it is left out.
    """
    if bounds not in ("iqr", "t"):
        raise ValueError(f"bounds is 'iqr' or 't', not {bounds!r}")
    each = df.select(*key, F.col(origin).alias("_at"), F.posexplode(forecasts).alias("_k", "_p"))
    steps = each.groupBy(*key, (F.col("_at") + F.col("_k")).alias("step")).agg(
        F.avg("_p").alias("mean"),
        F.stddev_pop("_p").alias("std"),
        F.count("_p").alias("n"),
        F.percentile("_p", 0.25).alias("_q1"),
        F.percentile("_p", 0.75).alias("_q3"),
    )
    truth = df.select(*key, F.col(origin).alias("step"), F.col(y).alias("true"))
    both = truth.join(steps, [*key, "step"])
    if bounds == "iqr":
        reach: Column = 1.5 * F.col("iqr")
        both = both.withColumn("iqr", F.col("_q3") - F.col("_q1"))
    else:
        if horizon is None:
            raise ValueError("t bounds need the horizon")
        table = F.array(F.lit(None).cast("double"), *[F.lit(t_quantile(m)) for m in range(1, horizon)])
        reach = F.col("margin")
        quantile = F.get(table, (F.col("n") - 1).cast("int"))
        both = both.withColumn("margin", quantile * F.col("std") / F.sqrt("n")).where("n > 1")
    return both.drop("_q1", "_q3").withColumns(
        {"lower_bound": F.col("mean") - reach, "upper_bound": F.col("mean") + reach}
    ).na.drop()


def series_maximum(df: DataFrame, key: Sequence[str] = KEY, value: str = "ap") -> DataFrame:
    """Largest value and number of rows of each series."""
    return df.groupBy(*key).agg(F.max(value).alias("maximum"), F.count(F.lit(1)).alias("n"))
