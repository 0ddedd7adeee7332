"""Forecast error measures as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Smallest denominator of the relative error, epsilon of the older measures.
MACHINE_EPSILON = 2.220446049250313e-16
EPSILON = 1e-10


def _abs_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def _squared_error(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def mae(y: Column, p: Column) -> Column:
    return F.avg(_abs_error(y, p))


def mse(y: Column, p: Column) -> Column:
    return F.avg(_squared_error(y, p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def relative_error(y: Column, p: Column) -> Column:
    """Mean absolute error relative to the actual value, as a fraction."""
    return F.avg(_abs_error(y, p) / F.greatest(F.abs(y), F.lit(MACHINE_EPSILON)))


def r2(y: Column, p: Column) -> Column:
    """1 for an exact forecast of a constant series, 0 for any other forecast of one."""
    residual = mse(y, p)
    spread = F.var_pop(F.when(p.isNotNull(), y))
    flat = F.when(residual == 0, 1.0).otherwise(0.0)
    return F.when(spread == 0, flat).otherwise(1 - F.try_divide(residual, spread))


def accuracy(y: Column, p: Column) -> dict[str, Column]:
    """The seven standard measures; null where the mean of the actual values is 0."""
    mean = F.avg(y)
    return {
        "mae": mae(y, p),
        "nmae": F.try_divide(mae(y, p), mean),
        "mape": relative_error(y, p),
        "mse": mse(y, p),
        "rmse": rmse(y, p),
        "nrmse": F.try_divide(rmse(y, p), mean),
        "r2": r2(y, p),
    }


def mape_percent(y: Column, p: Column, epsilon: float = EPSILON) -> Column:
    return F.avg(_abs_error(y, p) / (F.abs(y) + epsilon)) * 100


def smape_percent(y: Column, p: Column, epsilon: float = EPSILON) -> Column:
    return F.avg(2 * _abs_error(y, p) / (F.abs(y) + F.abs(p) + epsilon)) * 100


def modified_smape_percent(y: Column, p: Column, epsilon: float = 1.0) -> Column:
    return F.avg(_abs_error(y, p) / (F.abs(y) + F.abs(p) + epsilon)) * 100


def wmape_percent(y: Column, p: Column, epsilon: float = EPSILON) -> Column:
    """The epsilon is added on every row, so it counts n times."""
    return F.sum(_abs_error(y, p)) / F.sum(F.abs(y) + epsilon) * 100


def mean_squared(y: Column, p: Column, squared: bool = True) -> Column:
    """With ``squared`` the root is returned, as callers of the older measure expect."""
    return rmse(y, p) if squared else mse(y, p)


def agreement_percent(y: Column, p: Column, mean_y: Column) -> Column:
    """Index of agreement; ``mean_y`` is the mean of the group, joined to its rows."""
    error = F.sum(_squared_error(y, p))
    reach = F.abs(p - mean_y) + F.abs(y - mean_y)
    spread = F.sum(reach * reach)
    flat = F.when(error == 0, 100.0).otherwise(0.0)
    return F.when(spread == 0, flat).otherwise((1 - F.try_divide(error, spread)) * 100)


def error_above_percent(y: Column, p: Column, threshold: float = 0.1) -> Column:
    """Error on rows above the threshold; null without such rows, infinite when they sum to 0."""
    above = y > threshold
    total = F.sum(F.when(above, y))
    error = F.sum(F.when(above, _abs_error(y, p)))
    return F.when(total == 0, F.lit(float("inf"))).otherwise(F.try_divide(error, total) * 100)
