"""Calendar features scaled to [-0.5, 0.5] and their choice by frequency.

Fixed values of the reference's encoding: second/59, minute/59, hour/23,
weekday (Monday = 0)/6, (day of month - 1)/30, (day of year - 1)/365,
(month - 1)/11, (ISO week - 1)/52, each minus 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tf_second(ts) -> Column:
    return F.second(_c(ts)) / F.lit(59.0) - F.lit(0.5)


def tf_minute(ts) -> Column:
    return F.minute(_c(ts)) / F.lit(59.0) - F.lit(0.5)


def tf_hour(ts) -> Column:
    return F.hour(_c(ts)) / F.lit(23.0) - F.lit(0.5)


def tf_dow(ts) -> Column:
    return F.weekday(_c(ts)) / F.lit(6.0) - F.lit(0.5)


def tf_dom(ts) -> Column:
    return (F.dayofmonth(_c(ts)) - F.lit(1)) / F.lit(30.0) - F.lit(0.5)


def tf_doy(ts) -> Column:
    return (F.dayofyear(_c(ts)) - F.lit(1)) / F.lit(365.0) - F.lit(0.5)


def tf_month(ts) -> Column:
    return (F.month(_c(ts)) - F.lit(1)) / F.lit(11.0) - F.lit(0.5)


def tf_week(ts) -> Column:
    return (F.weekofyear(_c(ts)) - F.lit(1)) / F.lit(52.0) - F.lit(0.5)


FEATURES = {
    "second_of_minute": tf_second, "minute_of_hour": tf_minute, "hour_of_day": tf_hour,
    "day_of_week": tf_dow, "day_of_month": tf_dom, "day_of_year": tf_doy,
    "month_of_year": tf_month, "week_of_year": tf_week,
}

# feature list by frequency letter (fixed mapping of the reference)
BY_FREQ = {
    "y": [],
    "q": ["month_of_year"],
    "m": ["month_of_year"],
    "w": ["day_of_month", "week_of_year"],
    "d": ["day_of_week", "day_of_month", "day_of_year"],
    "b": ["day_of_week", "day_of_month", "day_of_year"],
    "h": ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "t": ["minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "s": ["second_of_minute", "minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
}


def time_features(ts, freq: str = "h") -> list[Column]:
    """The scaled calendar columns for a frequency string such as '15min',
    'h', 'd'; 'min' is an alias of 't', 'a' of 'y'."""
    f = freq.lower().lstrip("0123456789")
    f = {"min": "t", "a": "y"}.get(f, f)
    if f not in BY_FREQ:
        raise ValueError(f"unsupported frequency {freq}")
    return [FEATURES[n](ts).alias(n) for n in BY_FREQ[f]]


def time_features_raw(ts) -> list[Column]:
    """month, day, weekday (Monday = 0), hour as integers."""
    t = _c(ts)
    return [F.month(t).alias("month"), F.dayofmonth(t).alias("day"),
            F.weekday(t).alias("weekday"), F.hour(t).alias("hour")]
