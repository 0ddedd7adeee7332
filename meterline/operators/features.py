"""Rolling statistics, lags, targets and the feature matrix of a regular series."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F
from pyspark.sql import Window

from meterline.functions.calendar import CALENDAR_COLUMNS, calendar_features
from meterline.functions.clock import slot
from meterline.operators.chunks import (
    CHUNK, CHUNK_ROWS, at_home, chunk_rows, chunk_window, spread,
)
from meterline.operators.regular import join_weather, regular_grid
from meterline.session import KEY, STEPS_PER_DAY

log = logging.getLogger(__name__)

# Names of the statistics columns.
STATS_COLUMNS = [
    "rolling_mean", "rolling_median", "rolling_std", "rolling_min", "rolling_max",
    "diff_1", "diff_2", "ewm_mean",
]
# Weights of the exponential mean below this share of the newest one cannot change a double.
EWM_CUT = 1e-16
# exp() of a larger number leaves the range of a double.
EXP_LIMIT = 650.0


def ewm_reach(n: int) -> int:
    """Rows back after which the weight of an exponential mean of span ``n`` is nothing."""
    decay = 1 - 2 / (n + 1)
    return 0 if decay == 0 else math.ceil(math.log(EWM_CUT) / math.log(decay))


def _stats_rows(n: int, before: int, after: int) -> int:
    """Chunk length: wide enough for the copied rows, short enough for the weights to fit; 0 if no
    length is both.

    The reach of the weights alone always fits: it is 37 of the 650 that ``EXP_LIMIT`` allows.
    """
    rows = chunk_rows(before, after)
    decay = 1 - 2 / (n + 1)
    if decay == 0:
        return rows
    rows = min(rows, int(EXP_LIMIT / -math.log(decay)) - before - after)
    return rows if rows >= 4 * (before + after) else 0


def stats_features(
    n: int, w: WindowSpec, age: Column, value: str = "ap"
) -> dict[str, Column]:
    """Statistics over the last ``n`` rows, null until ``n`` values without a null are there.

    ``w`` is the ordered window of a chunk, ``age`` the row number counted from any fixed row of
    the chunk. The exponential mean is a ratio of two running sums weighted by ``decay**-age``:
    the common factor of the newest row cancels, so one pass gives the adjusted mean, nulls
    keeping their place.
    """
    x = F.col(value)
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(x).over(frame) == n
    whole = lambda c: F.when(full, c.over(frame))
    ordered = F.when(full, F.sort_array(F.collect_list(x).over(frame)))
    middle = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    decay = 1 - 2 / (n + 1)
    if decay == 0:
        ewm = F.last(x, ignorenulls=True).over(running)
    else:
        weight = F.exp(age * F.lit(-math.log(decay)))
        total = F.sum(x * weight).over(running)
        share = F.sum(F.when(x.isNotNull(), weight)).over(running)
        ewm = F.try_divide(total, share)
    values = [
        whole(F.avg(x)), middle, whole(F.stddev_samp(x)), whole(F.min(x)), whole(F.max(x)),
        x - F.lag(x, 1).over(w), x - F.lag(x, 2).over(w), ewm,
    ]
    return dict(zip(STATS_COLUMNS, values))


def _age(order: Column, rows: int) -> Column:
    return (order - F.col(CHUNK) * rows).cast("double")


def add_stats(
    df: DataFrame, n: int = 8, key: Sequence[str] = KEY, value: str = "ap", ts: str = "ts"
) -> DataFrame:
    """The eight statistics of a regular series (``regular_grid`` makes one)."""
    before = max(ewm_reach(n), n - 1, 2)
    rows = _stats_rows(n, before, 0)
    order = slot(F.col(ts))
    w = chunk_window(key, ts)
    cut = spread(df, order, before, 0, rows)
    return at_home(
        cut.select("*", *[c.alias(k) for k, c in stats_features(n, w, _age(order, rows), value).items()])
    )


def add_calendar(df: DataFrame, ts: str = "ts", match: str = "instant") -> DataFrame:
    return df.withColumns(calendar_features(F.col(ts), match))


def lag_plan(
    columns: Sequence[str], n: int, previous_days: int
) -> tuple[list[str], list[str], int]:
    """Columns that are also moved back by whole days, the other ones, and that shift in rows."""
    past = [c for c in columns if c.startswith("ap") or c in STATS_COLUMNS]
    return past, [c for c in columns if c not in past], previous_days * STEPS_PER_DAY


def feature_names(columns: Sequence[str], n: int = 8, previous_days: int = 0) -> list[str]:
    past, _, shift = lag_plan(columns, n, previous_days)
    return [f"{c}-{j + (shift if c in past else 0)}" for c in columns for j in range(n)]


def target_steps(horizon: int = 1, selected: Sequence[str] | None = None) -> dict[str, int]:
    """Targets by name and number of steps ahead; a malformed name is left out."""
    if not selected:  # a horizon of 0 makes rows to forecast from, without a target
        return {f"ap+{k}": k for k in range(1, horizon + 1)}
    steps = {}
    for name in selected:
        try:
            steps[name] = int(name.split("+")[1])
        except (IndexError, ValueError):
            log.warning("target %r is not of the form ap+<steps>, left out", name)
    return steps


def _shifted(
    df: DataFrame,
    columns: Sequence[str],
    n: int,
    shift_days: int,
    targets: dict[str, int],
    w: WindowSpec,
    keep: Sequence[str],
    wanted: Sequence[str] | None,
    complete: bool,
) -> DataFrame:
    """Lag structs instead of columns: 2n window functions whatever the number of columns.

    A flag per row tells whether all its columns are there, so ``complete`` rows are found from the
    lagged flags, also when only the ``wanted`` features are built.
    """
    past, now, shift = lag_plan(columns, n, shift_days)
    names = feature_names(columns, n, shift_days)
    wanted_set = set(names if wanted is None else wanted)
    unknown = wanted_set - set(names)
    if unknown:
        raise ValueError(f"missing {len(unknown)} features: {sorted(unknown)[:5]}")

    def packed(cols: list[str], back: int) -> tuple[list[str], Column]:
        used = [c for c in cols if any(f"{c}-{j + back}" in wanted_set for j in range(n))]
        there = F.lit(True)
        for c in cols:
            there = there & F.col(f"`{c}`").isNotNull()
        return used, F.struct(*[F.col(f"`{c}`") for c in used], there.alias("_there"))

    used_past, past_struct = packed(past, shift)
    used_now, now_struct = packed(now, 0)
    lags = []
    for j in range(n):
        lags.append(F.lag(past_struct, j + shift).over(w).alias(f"_p{j}"))
        if now:
            lags.append(F.lag(now_struct, j).over(w).alias(f"_q{j}"))
    ahead = [F.lead("ap", k).over(w).alias(name) for name, k in targets.items()]
    wide = df.select(*keep, *lags, *ahead)
    if complete:
        ok = F.lit(True)
        for j in range(n):
            ok = ok & F.col(f"_p{j}._there")
            if now:
                ok = ok & F.col(f"_q{j}._there")
        for name in targets:
            ok = ok & F.col(f"`{name}`").isNotNull()
        wide = wide.where(ok)
    out = []
    for c in columns:
        prefix, back = ("_p", shift) if c in past else ("_q", 0)
        if c in used_past or c in used_now:
            out += [
                F.col(f"{prefix}{j}.`{c}`").alias(f"{c}-{j + back}")
                for j in range(n)
                if f"{c}-{j + back}" in wanted_set
            ]
    return wide.select(*keep, *out, *[F.col(f"`{t}`") for t in targets])


def add_lags(
    df: DataFrame,
    n: int = 8,
    previous_days: int = 0,
    horizon: int = 1,
    selected: Sequence[str] | None = None,
    columns: Sequence[str] = ("ap",),
    key: Sequence[str] = KEY,
    ts: str = "ts",
    wanted: Sequence[str] | None = None,
    complete: bool = False,
) -> DataFrame:
    """Lag columns ``<column>-<j>`` and targets ``ap+<k>`` of a regular series.

    ``ap`` and the statistics are moved back by ``previous_days`` on top of the lag, the other
    columns are not. ``complete`` keeps only the rows without a null.
    """
    targets = target_steps(horizon, selected)
    before = n - 1 + previous_days * STEPS_PER_DAY
    after = max(targets.values(), default=0)
    cut = spread(df, slot(F.col(ts)), before, after)
    keep = [*key, ts, "_chunk", "_home"]
    return at_home(
        _shifted(
            cut, columns, n, previous_days, targets, chunk_window(key, ts), keep, wanted, complete
        )
    )


def feature_matrix(
    series: DataFrame,
    weather: DataFrame | None = None,
    n: int = 8,
    horizon: int = 1,
    previous_days: int = 1,
    calendar_on: bool = True,
    stats_on: bool = True,
    selected: Sequence[str] | None = None,
    key: Sequence[str] = KEY,
    wanted: Sequence[str] | None = None,
    complete: bool = True,
    match: str = "instant",
    weather_fill: str = "both",
    regular: bool = False,
) -> DataFrame:
    """Grid, weather, calendar, statistics, lags, targets, rows without nulls, in that order.

    ``series`` holds the key, ``ts`` and ``ap``. Statistics and lags share one shuffle and one sort
    by chunk, unless the day shift is too long for the weights of the exponential mean; then the
    statistics are a pass of their own, with chunks that reach as far back as they need. ``wanted`` builds only these features; the rows kept are the same as with all.
    ``regular`` says that the series already is a full grid.
    """
    base = series.select(*key, "ts", "ap")
    if not regular:
        base = regular_grid(base, key)
    columns = ["ap"]
    if weather is not None:
        base = join_weather(base, weather, key, weather_fill)
        columns += [c for c in weather.columns if c != "ts"]
    if calendar_on:
        base = add_calendar(base, match=match)
        columns += CALENDAR_COLUMNS
    shift = previous_days * STEPS_PER_DAY
    targets = target_steps(horizon, selected)
    after = max(targets.values(), default=0)
    before = shift + n - 1
    reach = max(ewm_reach(n), n - 1, 2) if stats_on else 0
    rows = _stats_rows(n, before + reach, after) if stats_on else max(CHUNK_ROWS, 4 * (before + after))
    order, w = slot(F.col("ts")), chunk_window(key)
    if rows:
        cut = spread(base, order, before + reach, after, rows)
        if stats_on:
            stats = stats_features(n, w, _age(order, rows))
            cut = cut.select("*", *[c.alias(k) for k, c in stats.items()])
    else:
        cut = spread(add_stats(base, n, key), order, before, after)
    if stats_on:
        columns += STATS_COLUMNS
    keep = [*key, "ts", "_chunk", "_home"]
    return at_home(
        _shifted(cut, columns, n, previous_days, targets, w, keep, wanted, complete)
    )


def history_of(features: Sequence[str], available: Sequence[str], n: int = 8) -> list[str]:
    """A base feature stands for itself and its ``n`` lags, as far as they exist."""
    there = set(available)
    return [c for f in features for c in [f, *[f"{f}-{j}" for j in range(n)]] if c in there]


def check_columns(df: DataFrame, features: Sequence[str]) -> int:
    """Number of features; features the frame does not have are an error."""
    missing = [f for f in features if f not in set(df.columns)]
    if missing:
        raise ValueError(f"missing {len(missing)} features: {missing[:5]}")
    return len(features)


def naive(df: DataFrame, lag: int = 1, key: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """Forecast by the value ``lag`` steps before: columns ``y`` and ``p``, rows with both."""
    cut = spread(df, slot(F.col(ts)), lag, 0)
    moved = cut.withColumn("p", F.lag("ap", lag).over(chunk_window(key, ts)))
    return at_home(moved).withColumnRenamed("ap", "y").where("y is not null and p is not null")
