"""Exploratory analyses of a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import wape
from ..shared import stored
from .checks import CHURN_DAYS, last_orders, monthly_with_last_year

#: Key sets from fine to coarse.
LADDER = (("rep_product", ("sales_rep", "product")), ("department_product", ("department", "product")), ("rep", ("sales_rep",)), ("department", ("department",)), ("company", ()))
#: Highest discount that each product is sold with.
CEILINGS = {"ECONOMY": 0.05, "LARGE": 0.06, "MEDIUM": 0.07, "PROMO": 0.10, "SMALL": 0.08, "STANDARD": 0.09}
LATE_DAYS = 90


def trailing_mean(column: str, rows: int, order: Window) -> Column:
    """Mean of the rows before, null until there are enough."""
    frame = order.rowsBetween(-rows, -1)
    return F.when(F.count(column).over(frame) == rows, F.sum(column).over(frame) / float(rows))


def granularity_ladder(fact: DataFrame, rows: int = 5) -> DataFrame:
    """level, n_series, wape of a trailing mean over observed days, for each key set; fact is read once."""
    out = []
    finest = stored(fact.groupBy("sales_rep", "department", "product", "order_date").agg(F.sum("amount").alias("amount")), "ladder")
    for level, keys in LADDER:
        series = finest.groupBy(*keys, "order_date").agg(F.sum("amount").alias("amount"))
        guessed = series.withColumn("forecast", trailing_mean("amount", rows, Window.partitionBy(*keys).orderBy("order_date"))).filter("forecast is not null")
        n = F.count_distinct(*keys) if keys else F.lit(1).cast("bigint")
        out.append(guessed.agg(n.alias("n_series"), F.round(wape(F.col("amount"), F.col("forecast")), 6).alias("wape")).select(F.lit(level).alias("level"), "n_series", "wape"))
    return reduce(DataFrame.unionByName, out)


def monthly_naive_scores(fact: DataFrame) -> DataFrame:
    """WAPE of three predictors of the company's months; fact is read once."""
    fact = stored(fact.groupBy("order_date").agg(F.sum("amount").alias("amount")), "days")
    months = fact.groupBy(F.trunc("order_date", "MM").alias("month")).agg(F.sum("amount").alias("amount"))
    recent = months.withColumn("f", trailing_mean("amount", 3, Window.orderBy("month"))).filter("f is not null").select(F.lit("mean3").alias("method"), "amount", "f")
    yoy = monthly_with_last_year(fact)
    growth = F.broadcast(yoy.agg(F.try_divide(F.sum("amount"), F.sum("last_year")).alias("growth")))
    same = yoy.select(F.lit("last_year").alias("method"), "amount", F.col("last_year").cast("double").alias("f"))
    grown = yoy.crossJoin(growth).select(F.lit("last_year_growth").alias("method"), "amount", (F.col("last_year") * F.col("growth")).alias("f"))
    return recent.unionByName(same).unionByName(grown).groupBy("method").agg(F.count("*").alias("n_months"), F.round(F.try_divide(F.sum(F.abs(F.col("amount") - F.col("f"))), F.sum("amount")), 6).alias("wape"))


def churned_customers(fact: DataFrame) -> DataFrame:
    positive = fact.filter("quantity > 0")
    end = F.broadcast(positive.agg(F.max("order_date").alias("end")))
    return last_orders(positive).crossJoin(end).filter(F.col("last_order") < F.date_sub("end", CHURN_DAYS)).drop("end")


def ceiling_of(product: Column, ceilings: dict[str, float] = CEILINGS) -> Column:
    """Strict lookup: an unknown product is an error."""
    table = F.create_map(*[F.lit(x) for pair in ceilings.items() for x in pair])
    return F.coalesce(F.try_element_at(table, product), F.raise_error(F.concat(F.lit("unknown product "), product)))


def churn_signals(fact: DataFrame, ceilings: dict[str, float] = CEILINGS) -> DataFrame:
    """Last days of churned customers against the time before; fact is read once."""
    fact = stored(fact.filter("quantity > 0").select("customer_code", "order_date", "discount", "product", "quantity"), "positive")
    target = fact.join(churned_customers(fact), "customer_code")
    late = F.col("order_date") > F.date_sub("last_order", LATE_DAYS)
    return (
        target.withColumns({"late": late, "pressure": F.col("discount") / ceiling_of(F.col("product"), ceilings)}).groupBy("late")
        .agg(F.count("*").alias("n_lines"), F.round(F.avg("pressure"), 4).alias("discount_pressure"), F.round(F.avg("quantity"), 1).alias("mean_quantity"))
    )


def basket_pairs(fact: DataFrame) -> DataFrame:
    """pair, n: sorted product lists of orders with two lines."""
    baskets = fact.filter("quantity > 0").groupBy("order_no").agg(F.sort_array(F.collect_list("product")).alias("items"))
    return baskets.filter(F.size("items") == 2).groupBy(F.array_join("items", " + ").alias("pair")).agg(F.count("*").alias("n"))


def basket_skew(fact: DataFrame) -> DataFrame:
    pairs = basket_pairs(fact)
    top = F.max_by("pair", F.struct(F.col("n"), -F.col("place")))
    placed = pairs.withColumn("place", F.row_number().over(Window.orderBy("pair")))
    return placed.agg(F.sum("n").alias("n_orders"), F.count("*").alias("n_pairs"), F.max("n").alias("most"), F.min("n").alias("least"), F.round(F.try_divide(F.max("n"), F.min("n")), 6).alias("skew"), top.alias("top_pair"))


def anomaly_kind_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("kind").agg(F.count("*").alias("n"))


def naive_anomaly_fp_rate(fact: DataFrame, labels: DataFrame) -> DataFrame:
    """How wrong "a negative quantity is an anomaly" is."""
    negative = fact.filter("quantity < 0")
    hits = negative.join(labels.select("order_no", "line_no").distinct(), ["order_no", "line_no"], "left_semi").agg(F.count("*").alias("flagged"))
    return negative.agg(F.count("*").alias("negative")).crossJoin(hits).withColumn("fp_rate", F.round(1 - F.try_divide(F.col("flagged"), F.col("negative")), 6))


def series_summary(fact: DataFrame, business_days: DataFrame) -> DataFrame:
    """Size, density and margin of the ledger; zero shares are over department x product series."""
    daily = fact.select("department", "product", "order_date").distinct().agg(F.count("*").alias("observed"))
    series = fact.select("department", "product").distinct().agg(F.count("*").alias("n_series"))
    base = fact.agg(
        F.count("*").alias("n_lines"), F.count_distinct("customer_code").alias("n_customers"), F.count_distinct("sales_rep").alias("n_reps"), F.count_distinct("product").alias("n_products"),
        (F.datediff(F.max("order_date"), F.min("order_date")) + 1).cast("bigint").alias("n_days"), F.sum("amount").alias("amount"), F.round(F.try_divide(F.sum("profit"), F.sum("amount")), 6).alias("margin"),
    )
    days = business_days.agg(F.count("*").alias("n_business_days"))
    joined = base.crossJoin(series).crossJoin(daily).crossJoin(days)
    cells = F.col("n_series") * F.col("n_business_days")
    return joined.withColumns(
        {"zero_share_business": F.round(1 - F.try_divide(F.col("observed"), cells), 6), "zero_share_days": F.round(1 - F.try_divide(F.col("observed"), F.col("n_series") * F.col("n_days")), 6)}
    )


def weekday_order_counts(fact: DataFrame) -> DataFrame:
    return fact.groupBy((F.weekday("order_date") + 1).alias("weekday")).agg(F.count("*").alias("n"))
