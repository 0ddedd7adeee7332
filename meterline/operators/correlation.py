"""Auto-correlation, partial auto-correlation and the order of differencing.

All three come from the same sums per series: the products of a value with its earlier values, and
the few values at both ends. Only those sums, one row per series, reach Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from meterline.functions.clock import slot
from meterline.operators.chunks import at_home, chunk_window, spread
from meterline.session import KEY

# Fixed value: 5 percent point of the unit-root statistic with a constant.
UNIT_ROOT_5_PERCENT = -2.86154


def lag_moments(
    df: DataFrame,
    max_lag: int,
    key: Sequence[str] = KEY,
    ts: str = "ts",
    value: str = "ap",
) -> DataFrame:
    """Per series: length ``n``, array ``products`` of the sums of x[t]*x[t-h] for h = 0..max_lag
    with x less its mean, and the first and last ``max_lag`` values of x.

    The series is a full grid without nulls.
    """
    ends = df.groupBy(*key).agg(
        F.avg(value).alias("_mean"),
        F.min(slot(F.col(ts))).alias("_first"),
        F.max(slot(F.col(ts))).alias("_last"),
    )
    x = F.col(value) - F.col("_mean")
    at = slot(F.col(ts))
    rows = df.join(ends, list(key)).select(
        *key, ts, x.alias("_x"), (at - F.col("_first")).alias("_pos"), (F.col("_last") - at).alias("_left")
    )
    cut = spread(rows, slot(F.col(ts)), max_lag, 0)
    w = chunk_window(key, ts)
    lagged = at_home(
        cut.select("*", *[F.lag("_x", h).over(w).alias(f"_x{h}") for h in range(1, max_lag + 1)])
    ).withColumn("_x0", F.col("_x"))
    # Values near the start have no earlier value in the series, and none is counted.
    sums = [F.sum(F.col("_x") * F.col(f"_x{h}")) for h in range(max_lag + 1)]
    entry = F.struct("_pos", "_x")
    head = F.sort_array(F.collect_list(F.when(F.col("_pos") < max_lag, entry)))
    tail = F.sort_array(F.collect_list(F.when(F.col("_left") < max_lag, entry)))
    return lagged.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*sums).alias("products"),
        F.transform(head, lambda e: e["_x"]).alias("head"),
        F.transform(tail, lambda e: e["_x"]).alias("tail"),
    )


def autocorrelation(
    df: DataFrame, lags: int = 20, key: Sequence[str] = KEY, ts: str = "ts", value: str = "ap"
) -> DataFrame:
    """Auto-correlation for lags 0..``lags``; every lag is divided by the same total."""
    moments = lag_moments(df, lags, key, ts, value)
    total = F.get("products", F.lit(0))
    return moments.select(
        *key, total.alias("_total"), F.posexplode("products").alias("lag", "_sum")
    ).select(*key, "lag", F.try_divide("_sum", "_total").alias("acf"))


def _windowed(row, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over t >= start of x[t-i]*x[t-j] and of x[t-i], for i, j <= start."""
    head, tail = np.asarray(row.head, float), np.asarray(row.tail, float)
    products, n = np.asarray(row.products, float), int(row.n)
    gram = np.empty((start + 1, start + 1))
    sums = np.empty(start + 1)
    for i in range(start + 1):
        # x is less its mean, so all values together sum to 0.
        sums[i] = -head[: start - i].sum() - (tail[len(tail) - i:].sum() if i else 0.0)
        for j in range(i + 1):
            h = i - j
            early = head[h: start - j] @ head[: start - i]
            late = tail[len(tail) - j:] @ tail[len(tail) - i: len(tail) - h] if j else 0.0
            gram[i, j] = gram[j, i] = products[h] - early - late
    return gram, sums, n - start


def _with_constant(gram: np.ndarray, sums: np.ndarray, m: int) -> np.ndarray:
    """Gram matrix of the same columns and a constant one."""
    return np.block([[gram, sums[:, None]], [sums[None, :], np.array([[float(m)]])]])


def _pacf_of(row, lags: int) -> list[float]:
    values = [1.0]
    for k in range(1, lags + 1):
        gram, sums, m = _windowed(row, k)
        full = _with_constant(gram, sums, m)
        beta = np.linalg.lstsq(full[1:, 1:], full[1:, 0], rcond=None)[0]
        values.append(float(beta[k - 1]))
    return values


def partial_autocorrelation(
    df: DataFrame, lags: int = 20, key: Sequence[str] = KEY, ts: str = "ts", value: str = "ap"
) -> DataFrame:
    """Last coefficient of the regression on 1..k earlier values and a constant, k = 1..``lags``.

    A series of ``2 * lags`` rows or fewer has one row without lag and value and the status
    ``short``; all other rows have the status ``ok``.
    """
    moments = lag_moments(df, lags, key, ts, value)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(key)].copy()
            out["pacf"] = [_pacf_of(row, lags) if row.n > 2 * lags else None for row in batch.itertuples()]
            yield out

    schema = T.StructType(
        [f for f in moments.schema.fields if f.name in key]
        + [T.StructField("pacf", T.ArrayType(T.DoubleType()))]
    )
    solved = moments.mapInPandas(solve, schema)
    status = F.when(F.col("pacf").isNull(), "short").otherwise("ok").alias("status")
    return solved.select(*key, status, F.posexplode_outer("pacf").alias("lag", "pacf"))


def _difference(order: int) -> np.ndarray:
    """Weights of x[t], x[t-1], ... in the difference of that order."""
    weights = np.array([1.0])
    for _ in range(order):
        weights = np.convolve(weights, [1.0, -1.0])
    return weights


def _unit_root(gram: np.ndarray, sums: np.ndarray, m: int, d: int, p: int) -> tuple[float, float]:
    """t statistic of the level and information criterion of the regression with p differences."""
    width = len(sums)
    rows = []
    for weights, back in [(_difference(d + 1), 0), (_difference(d), 1)] + [
        (_difference(d + 1), i) for i in range(1, p + 1)
    ]:
        line = np.zeros(width)
        line[back: back + len(weights)] = weights
        rows.append(line)
    combine = np.array(rows)
    full = _with_constant(combine @ gram @ combine.T, combine @ sums, m)
    inverse = np.linalg.pinv(full[1:, 1:], hermitian=True)
    beta = inverse @ full[1:, 0]
    residual = max(full[0, 0] - full[0, 1:] @ beta, 0.0)
    count = len(beta)
    if residual == 0 or m <= count:
        return -math.inf, -math.inf
    error = math.sqrt(residual / (m - count) * inverse[0, 0])
    loglike = -m / 2 * (math.log(2 * math.pi) + math.log(residual / m) + 1)
    return float(beta[0] / error), -2 * loglike + 2 * count


def usual_lags(n: int) -> int:
    """Largest number of differences tried for a series of length ``n``."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def _order_of(row, max_d: int, fixed: int | None) -> tuple[int | None, float | None, int | None, str]:
    """Order, statistic and lags of the undifferenced series, and how the search ended."""
    statistic, used, n = None, None, int(row.n)
    for d in range(max_d + 1):
        most = usual_lags(n - d) if fixed is None else fixed
        if n <= 2 * (most + 1 + d):
            return None, statistic, used, "short"
        chosen = most
        if fixed is None:
            gram, sums, m = _windowed(row, most + 1 + d)
            chosen = int(np.argmin([_unit_root(gram, sums, m, d, p)[1] for p in range(most + 1)]))
        value, _ = _unit_root(*_windowed(row, chosen + 1 + d), d, chosen)
        if d == 0:
            statistic, used = value, chosen
        if value <= UNIT_ROOT_5_PERCENT:
            return d, statistic, used, "rejected"
    return max_d, statistic, used, "not_rejected"


def difference_order(
    df: DataFrame,
    p: int | None = None,
    max_d: int = 2,
    key: Sequence[str] = KEY,
    ts: str = "ts",
    value: str = "ap",
) -> DataFrame:
    """Differences needed until the unit-root test rejects at 5 percent, at most ``max_d``.

    ``p`` differenced lags enter the regression; without it the number with the smallest
    information criterion is taken, out of ``usual_lags`` of the series' length. Every series has a row;
    ``status`` tells whether the test rejected, never did up to ``max_d``, or had too short a
    series.
    """
    if p is None:
        longest = df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
        reach = usual_lags(longest) + 1 + max_d
    else:
        reach = p + 1 + max_d
    moments = lag_moments(df, reach, key, ts, value)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_order_of(row, max_d, p) for row in batch.itertuples()]
            out = batch[list(key)].copy()
            out["d"] = pd.array([f[0] for f in found], "Int32")
            out["statistic"] = pd.array([f[1] for f in found], "Float64")
            out["lags"] = pd.array([f[2] for f in found], "Int32")
            out["status"] = [f[3] for f in found]
            yield out

    schema = T.StructType(
        [f for f in moments.schema.fields if f.name in key]
        + [
            T.StructField("d", T.IntegerType()),
            T.StructField("statistic", T.DoubleType()),
            T.StructField("lags", T.IntegerType()),
            T.StructField("status", T.StringType()),
        ]
    )
    return moments.mapInPandas(solve, schema)
