"""Calendar features and Belgian public holidays as plain expressions of a time stamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Feature names, holidays on fixed dates (month, day), holidays counted in days
# after Easter Sunday, first and last peak hour.
CALENDAR_COLUMNS = [
    "hour", "hour_sin", "hour_cos", "dayofweek", "dayofweek_sin", "dayofweek_cos",
    "month", "month_sin", "month_cos", "day", "year", "weekofyear", "weekend",
    "season", "season_sin", "season_cos", "holiday", "is_peak_hour",
]
FIXED_HOLIDAYS = [(1, 1), (5, 1), (7, 21), (8, 15), (11, 1), (11, 11), (12, 25)]
EASTER_HOLIDAYS = [1, 39, 50]
PEAK_HOURS = (7, 22)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def easter_sunday(year: Column) -> Column:
    """Date of Easter Sunday, Gregorian calendar, by integer arithmetic on the year."""
    century = _div(year, 100)
    golden = year % 19
    leap_centuries = century - _div(century, 4)
    moon_drift = _div(F.lit(8) * century + 13, 25)
    epact = (leap_centuries - moon_drift + F.lit(19) * golden + 15) % 30
    # Two late full moons are brought forward by a day.
    late = ((epact == 29) | ((epact == 28) & (golden > 10))).cast("int")
    full_moon = epact - late  # days after 21 March
    weekday = (year + _div(year, 4) + full_moon + 2 - leap_centuries) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(21)), full_moon + 7 - weekday)


def is_holiday(ts: Column, match: str = "instant") -> Column:
    """True on a holiday.

    ``match='instant'`` compares the whole stamp with the midnights of the holidays, so only the
    first step of the day is marked; ``match='day'`` marks the whole day.
    """
    if match not in ("instant", "day"):
        raise ValueError(f"match is 'instant' or 'day', not {match!r}")
    day = F.to_date(ts)
    month_day = F.month(ts) * 100 + F.dayofmonth(ts)
    after_easter = F.date_diff(day, easter_sunday(F.year(ts)))
    hit = month_day.isin([m * 100 + d for m, d in FIXED_HOLIDAYS]) | after_easter.isin(
        EASTER_HOLIDAYS
    )
    return hit & (ts == F.date_trunc("day", ts)) if match == "instant" else hit


def holiday_dates(year: Column) -> Column:
    """Array of the holidays of a year."""
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    moving = [F.date_add(easter_sunday(year), n) for n in EASTER_HOLIDAYS]
    return F.array_sort(F.array(*fixed, *moving))


def calendar_features(ts: Column, match: str = "instant") -> dict[str, Column]:
    """The calendar columns of a stamp, by name, in feature order."""

    def cycle(value: Column, period: int) -> tuple[Column, Column]:
        angle = F.lit(2 * math.pi) * value / F.lit(period)
        return F.sin(angle), F.cos(angle)

    hour, weekday, month = F.hour(ts), F.weekday(ts), F.month(ts)
    season = _div(month % 12, 3)
    weekend = weekday > 4
    holiday = is_holiday(ts, match)
    peak = hour.between(*PEAK_HOURS) & ~weekend & ~holiday
    hour_sin, hour_cos = cycle(hour, 24)
    weekday_sin, weekday_cos = cycle(weekday, 7)
    month_sin, month_cos = cycle(month, 12)
    season_sin, season_cos = cycle(season, 4)
    values = [
        hour, hour_sin, hour_cos, weekday, weekday_sin, weekday_cos, month, month_sin, month_cos,
        F.dayofmonth(ts), F.year(ts), F.weekofyear(ts), weekend.cast("int"),
        season, season_sin, season_cos, holiday.cast("int"), peak.cast("int"),
    ]
    return dict(zip(CALENDAR_COLUMNS, values))
