"""Expanding-window folds over an ordered list of distinct dates ("steps")."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    index: int
    train_start: dt.date
    train_end: dt.date
    val_start: dt.date
    val_end: dt.date
    train_steps: int
    val_steps: int


def expanding_folds(dates: Sequence[dt.date], n_splits: int, val_steps: int, gap_steps: int = 0) -> list[Fold]:
    """Oldest first; the last fold ends with the data, training always starts with it and ends gap_steps early."""
    if n_splits < 1 or val_steps < 1 or gap_steps < 0:
        raise ValueError("n_splits and val_steps are at least 1, gap_steps at least 0")
    steps = sorted(set(dates))
    first = len(steps) - n_splits * val_steps
    if first - gap_steps < 1:
        raise ValueError(f"{len(steps)} steps are too few for {n_splits} folds of {val_steps}")
    out = []
    for k in range(n_splits):
        val = first + k * val_steps
        train = val - gap_steps
        out.append(Fold(k, steps[0], steps[train - 1], steps[val], steps[val + val_steps - 1], train, val_steps))
    return out


def split(df: DataFrame, fold: Fold, date: str = "date") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(date).between(fold.train_start, fold.train_end)), df.filter(F.col(date).between(fold.val_start, fold.val_end))
