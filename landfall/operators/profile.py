"""A profile of any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles

LOW_CARDINALITY = 15
#: Parts of a name that speak for a date.
DATE_NAMES = ("date", "day", "time", "ymd", "日付", "年月")
QUARTILES = (0.25, 0.5, 0.75)


def shape(df: DataFrame) -> DataFrame:
    """n_rows, n_columns."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def _text(field: T.StructField) -> Column:
    """The value as text, equal for equal values: there is one zero."""
    column = F.col(f"`{field.name}`")
    return (column + F.lit(0.0) if isinstance(field.dataType, T.FractionalType) and not isinstance(field.dataType, T.DecimalType) else column).cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value (text, null too), n: one scan for all columns, with partial sums before values move."""
    chosen = [f for f in df.schema if columns is None or f.name in columns]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), _text(f).alias("value")) for f in chosen])
    return df.select(F.explode(pairs).alias("e")).groupBy("e.column", "e.value").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame) -> DataFrame:
    """column, kind, n_nulls, null_percent, n_unique (a null counts as a value); a column of an empty table has no values."""
    found = value_counts(df).groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"), F.sum("n").alias("_n"), F.count("*").alias("n_unique")
    )
    kinds = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind")) for f in df.schema]
    every = df.sparkSession.range(1).select(F.explode(F.array(*kinds)).alias("k")).select("k.*")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = F.broadcast(every).join(found, "column", "left")  # a row a column
    return joined.select("column", "kind", zero("n_nulls"), F.round(F.try_divide(F.col("n_nulls") * 100.0, F.col("_n")), 6).alias("null_percent"), zero("n_unique"))


def numeric_summary(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, quartiles and bounds of every numeric column."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n bigint, n_nulls bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("double").alias("v")) for n in names])).alias("e")).select("e.*")
    plain = long.groupBy("column").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_nulls"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev("v"), 4).alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    wide = exact_quantiles(long, QUARTILES).groupBy("column").agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"q{round(q * 100)}") for q in QUARTILES])
    return plain.join(wide, "column", "left").select("column", "n", "n_nulls", "mean", "std", "min", "q25", "q50", "q75", "max")


def low_cardinality_values(df: DataFrame, columns: list[str] | None = None, limit: int = LOW_CARDINALITY) -> DataFrame:
    """column, value (text) for every value of the columns, all by default, that have no more than limit of them (a null counts)."""
    values = value_counts(df, columns)
    small = values.groupBy("column").agg(F.count("*").alias("k")).filter(F.col("k") <= limit).select("column")
    return values.join(F.broadcast(small), "column").select("column", "value")  # a row a column


def date_columns(df: DataFrame) -> list[str]:
    """Columns that are dates by type or by name."""
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, dates) or any(k in f.name.lower() for k in DATE_NAMES)]


def date_span(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First and last day, days between and days without a row, for each date column, by default those found; null where values are no dates."""
    parts = []
    for name in date_columns(df) if columns is None else columns:
        day = F.to_date(F.try_to_timestamp(F.col(f"`{name}`").cast("string")))
        parts.append(
            df.groupBy(day.alias("day")).agg(F.lit(1)).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("bigint").alias("n_days"), F.count("day").alias("n_present"))
            .withColumn("n_missing", F.col("n_days") - F.col("n_present")).select(F.lit(name).alias("column"), "*")
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, first_day date, last_day date, n_days bigint, n_present bigint, n_missing bigint")
    return reduce(DataFrame.unionByName, parts)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_duplicates of whole rows."""
    rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))
