"""Japanese business calendar as columns: holidays, substitutes, business days, calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Holidays with a date, and those on the nth Monday of a month.
FIXED_HOLIDAYS = ((1, 1), (2, 11), (2, 23), (4, 29), (5, 3), (5, 4), (5, 5), (8, 11), (11, 3), (11, 23))
NTH_MONDAYS = ((1, 2), (7, 3), (9, 3), (10, 2))
#: Fixed values of the equinox formula, good for 1980 to 2099.
SPRING, AUTUMN, DRIFT = 20.8431, 23.2488, 0.242194


def _equinox(day: Column, base: float) -> Column:
    years = F.year(day) - 1980
    return F.floor(F.lit(base) + F.lit(DRIFT) * years - F.floor(years / 4))


def statutory(day: Column) -> Column:
    """Holidays before substitution."""
    month, dom = F.month(day), F.dayofmonth(day)
    found = F.lit(False)
    for m, d in FIXED_HOLIDAYS:
        found = found | ((month == m) & (dom == d))
    for m, n in NTH_MONDAYS:
        found = found | ((F.weekday(day) == 0) & (month == m) & dom.between(7 * n - 6, 7 * n))
    return found | ((month == 3) & (dom == _equinox(day, SPRING))) | ((month == 9) & (dom == _equinox(day, AUTUMN)))


def holiday(day: Column) -> Column:
    """Holiday, substitute for one on a Sunday (the next day that is none itself), or year end.

    Runs of holidays have three days at most, so a substitute lies within three days of its Sunday.
    """
    runs = F.lit(False)
    run = F.lit(True)
    for back in (1, 2, 3):
        earlier = F.date_sub(day, back)
        run = run & statutory(earlier)
        runs = runs | (run & (F.weekday(earlier) == 6))
    month, dom = F.month(day), F.dayofmonth(day)
    return statutory(day) | runs | ((month == 12) & (dom >= 30)) | ((month == 1) & (dom <= 3))


def days_between(bounds: DataFrame) -> DataFrame:
    """One row a day from a one-row frame (first, last)."""
    return bounds.select(F.explode(F.sequence("first", "last")).alias("day"))


def business_grid(bounds: DataFrame) -> DataFrame:
    """order_date, month, step (from 1), cal_days: business days numbered within their month."""
    days = days_between(bounds).filter((F.weekday("day") < 5) & ~holiday(F.col("day"))).select(F.col("day").alias("order_date"), F.trunc("day", "MM").alias("month"))
    month = Window.partitionBy("month")
    return days.withColumns({"step": F.row_number().over(month.orderBy("order_date")), "cal_days": F.count("*").over(month)})


def add_calendar_features(df: DataFrame, date: str = "date", fourier_order: int = 3) -> DataFrame:
    day = F.col(date)
    out = df.withColumns(
        {
            "cal_dow": (F.weekday(day) + 1).cast("tinyint"), "cal_month": F.month(day).cast("tinyint"), "cal_day": F.dayofmonth(day).cast("tinyint"),
            "cal_week": F.weekofyear(day).cast("tinyint"), "cal_doy": F.dayofyear(day).cast("smallint"), "cal_is_holiday": holiday(day).cast("tinyint"),
            "cal_is_weekend": (F.weekday(day) >= 5).cast("tinyint"), "cal_is_month_start": (F.dayofmonth(day) <= 5).cast("tinyint"), "cal_is_month_end": (F.dayofmonth(day) >= 25).cast("tinyint"),
        }
    )
    waves = {}
    for k in range(1, fourier_order + 1):
        angle = F.col("cal_doy").cast("double") * F.lit(2.0 * math.pi * k / 365.25)
        waves |= {f"cal_yearly_sin_{k}": F.sin(angle), f"cal_yearly_cos_{k}": F.cos(angle)}
    return out.withColumns(waves) if waves else out
