"""Exact quantiles of whole columns, without all values meeting in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch that finds the values around a quantile: its ranks are off by one part in this number at most.
ACCURACY = 20_000


def exact_quantiles(long: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """column, q, value (interpolated) for rows (column, v: double); nulls do not count.

    A sketch gives values that lie surely on either side of each quantile; for no more rows than ACCURACY
    all lie between. Then the rows below are counted, and only those between are grouped by value and put
    in order.
    """
    rows = long.filter("v is not null").select("column", "v")
    margin = 2.0 / ACCURACY
    around = [x for q in quantiles for x in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = rows.groupBy("column").agg(F.count("*").alias("n"), F.percentile_approx("v", around, ACCURACY).alias("p"))
    edge = lambda k, bound: F.when(F.col("n") > ACCURACY, F.col("p")[k]).otherwise(F.lit(float(bound)))
    spans = F.array(*[F.struct(F.lit(float(q)).alias("q"), edge(2 * k, "-inf").alias("low"), edge(2 * k + 1, "inf").alias("high")) for k, q in enumerate(quantiles)])
    edges = F.broadcast(sketch.select("column", "n", spans.alias("spans")))  # a row a column
    met = rows.join(edges, "column").select("column", "n", "v", F.explode("spans").alias("s")).filter(F.col("v") <= F.col("s.high"))
    inside = F.col("v") >= F.col("s.low")
    counted = met.groupBy("column", "n", F.col("s.q").alias("q"), F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("column", "q").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("c").over(order))
    place = F.col("q") * (F.col("n") - 1)
    low, high = F.floor(place), F.ceil(place)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = ranked.withColumns({"place": place, "low": low, "high": high}).groupBy("column", "q", "place", "low", "high").agg(at(F.col("low")).alias("a"), at(F.col("high")).alias("b"))
    return found.select("column", "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("high") - F.col("place")) * F.col("a") + (F.col("place") - F.col("low")) * F.col("b")).alias("value"))
