"""Forecast metrics as aggregate columns; a zero denominator or no rows give null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(f - y))


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(F.avg((f - y) * (f - y)))


def wape(y: Column, f: Column) -> Column:
    return F.try_divide(F.sum(F.abs(f - y)), F.sum(F.abs(F.when(f.isNotNull(), y))))


def bias(y: Column, f: Column) -> Column:
    return F.try_divide(F.sum(f - y), F.sum(F.when(f.isNotNull(), y)))


def smape(y: Column, f: Column) -> Column:
    size = F.abs(y) + F.abs(f)
    return F.avg(F.when(size > 0, F.abs(f - y) * 2 / size))


def pinball(y: Column, f: Column, q: float) -> Column:
    if not 0 < q < 1:
        raise ValueError("a quantile lies between 0 and 1")
    return F.avg(F.greatest((y - f) * q, (y - f) * (q - 1)))


def coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(F.when(low.isNotNull() & high.isNotNull(), y.between(low, high).cast("double")))


def point_bundle(y: Column, f: Column) -> dict[str, Column]:
    return {"wape": wape(y, f), "mae": mae(y, f), "rmse": rmse(y, f), "smape": smape(y, f), "bias": bias(y, f)}


def quantile_bundle(y: Column, forecasts: Mapping[float, Column]) -> dict[str, Column]:
    """Point metrics of the median, pinball loss of each quantile, coverage of the outermost interval."""
    if 0.5 not in forecasts:
        raise KeyError(0.5)
    low, high = min(forecasts), max(forecasts)
    out = point_bundle(y, forecasts[0.5]) | {f"pinball_q{round(q * 100)}": pinball(y, f, q) for q, f in sorted(forecasts.items())}
    return out | {"interval_coverage": coverage(y, forecasts[low], forecasts[high]), "interval_nominal": F.lit(round(high - low, 10))}


def evaluate(df: DataFrame, metrics: Mapping[str, Column], y: Column, *forecasts: Column) -> dict[str, float | None]:
    """The metrics of a whole table; ValueError if it has no rows, or rows in which not all of y and forecasts stand."""
    whole = y.isNotNull()
    for f in forecasts:
        whole = whole & f.isNotNull()
    row = df.agg(F.count("*").alias("_n"), F.count_if(~whole).alias("_broken"), *[c.alias(n) for n, c in metrics.items()]).first()
    if not row["_n"]:
        raise ValueError("nothing to evaluate")
    if row["_broken"]:
        raise ValueError(f"{row['_broken']} of {row['_n']} rows lack a value or a forecast")
    return {n: row[n] for n in metrics}
