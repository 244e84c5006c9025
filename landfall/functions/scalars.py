"""Scalars taken out of one-row results, with their kinds checked."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal


def as_date(value: object) -> dt.date:
    """A date, or the day of a timestamp; TypeError for anything else."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    raise TypeError(f"not a date: {value!r}")


def as_float(value: object) -> float:
    """A number as a float; TypeError for anything else, nulls and booleans too."""
    if isinstance(value, int | float | Decimal) and not isinstance(value, bool):
        return float(value)
    raise TypeError(f"not a number: {value!r}")
