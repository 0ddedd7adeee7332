"""Time arithmetic on the 15-minute grid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meterline.session import STEP_SECONDS


def floor_to(ts: Column, seconds: int = STEP_SECONDS) -> Column:
    """Start of the step that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(seconds)) * F.lit(seconds))


def slot(ts: Column, seconds: int = STEP_SECONDS) -> Column:
    """Running number of the step since the epoch."""
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("long")


def shift_steps(ts: Column, steps: Column | int, seconds: int = STEP_SECONDS) -> Column:
    """``ts`` moved by a number of steps."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    return F.timestamp_micros(F.unix_micros(ts) + steps.cast("long") * F.lit(seconds * 1_000_000))


def cutoff(now: Column, delay_days: int) -> Column:
    """Last stamp known when the data arrive ``delay_days`` late."""
    return F.timestamp_seconds(F.unix_seconds(floor_to(now)) - F.lit(delay_days * 86_400))


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def from_day_number(days: Column) -> Column:
    """Spreadsheet day number (day 0 is 1899-12-30) to a time stamp."""
    return F.timestamp_micros(F.round((days - F.lit(25_569.0)) * F.lit(86_400e6)).cast("long"))
