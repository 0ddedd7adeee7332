"""Sequence samples and slices by row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from meterline.functions.clock import slot
from meterline.operators.chunks import at_home, chunk_window, spread, with_position
from meterline.session import KEY, STEPS_PER_DAY


def every_nth(df: DataFrame, step: int, key: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """Rows 0, step, 2*step, ... of each series."""
    return with_position(df, key, ts).where(F.col("pos") % step == 0).drop("pos", "n")


def slices(
    df: DataFrame,
    size: int = 7 * STEPS_PER_DAY,
    key: Sequence[str] = KEY,
    ts: str = "ts",
    drop_short: bool = False,
) -> DataFrame:
    """Number the consecutive slices of ``size`` rows; ``drop_short`` leaves out a short last one."""
    cut = with_position(df, key, ts).withColumn("slice", F.floor(F.col("pos") / size).cast("long"))
    if drop_short:
        cut = cut.where((F.col("slice") + 1) * size <= F.col("n"))
    return cut.drop("n")


def windows(
    df: DataFrame,
    seq: int,
    out: int,
    past: Sequence[str] = ("ap",),
    now: Sequence[str] = (),
    lag: int = 0,
    previous_days: int = 0,
    step: int = 1,
    gap_safe: bool = False,
    key: Sequence[str] = KEY,
    ts: str = "ts",
) -> DataFrame:
    """Samples ``x_past``, ``x_now`` and ``y`` that start at every ``step``-th row.

    ``x_past`` holds ``seq`` rows from ``previous_days`` before the start, ``x_now`` ``seq`` rows
    from the start, ``y`` ``out`` values from ``seq + lag`` rows after the start. Windows count
    rows, so they run over removed periods; ``gap_safe`` keeps only those without one inside.
    """
    shift = previous_days * STEPS_PER_DAY
    ahead = seq + lag + out - 1
    numbered = with_position(df, key, ts)
    cut = spread(numbered, F.col("pos"), shift, ahead)
    w = chunk_window(key, "pos")

    def block(cols: Sequence[str], start: int, size: int):
        row = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
        return F.collect_list(row).over(w.rowsBetween(start, start + size - 1))

    parts = [block(past, -shift, seq).alias("x_past")]
    if now:
        parts.append(block(now, 0, seq).alias("x_now"))
    parts.append(
        F.collect_list(F.col("ap")).over(w.rowsBetween(seq + lag, ahead)).alias("y")
    )
    span = F.lead(ts, ahead).over(w)
    back = F.lag(ts, shift).over(w)
    rows = at_home(
        cut.select(*key, ts, "pos", "n", "_chunk", "_home", *parts,
                   (slot(span) - slot(back)).alias("_span"))
    )
    need = seq + out + lag + shift
    starts = (F.col("pos") >= shift) & (F.col("pos") + ahead < F.col("n"))
    kept = rows.where(starts & ((F.col("pos") - shift) % step == 0) & (F.col("n") >= need))
    if gap_safe:
        kept = kept.where(F.col("_span") == F.lit(ahead + shift))
    return kept.drop("n", "_span")
