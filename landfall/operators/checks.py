"""Seven acceptance checks of a ledger, each one row (name, value, passed)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

#: Bounds within which a ledger is fit for forecasting.
YOY_WAPE, CHURN, ANOMALY, LARGE = (0.15, 0.25), (0.10, 0.25), (0.003, 0.02), (0.005, 0.03)
MIN_ORDERS_PER_CUSTOMER_MONTH = 1.0
CHURN_DAYS = 120
LARGE_TIMES = 10


def _month() -> Column:
    return F.trunc("order_date", "MM")


def _one(df: DataFrame, name: str, value: Column, passed: Column) -> DataFrame:
    """The bound is held against the value itself; what is shown is rounded."""
    return df.select(value.cast("double").alias("raw")).select(F.lit(name).alias("name"), F.round("raw", 6).alias("value"), passed.alias("passed"))


def _within(bounds: tuple[float, float]) -> Column:
    return F.col("raw").between(*bounds)


def monthly_with_last_year(fact: DataFrame) -> DataFrame:
    """month, amount, last_year over the months that have one; a month is a row, so the window is small."""
    months = fact.groupBy(_month().alias("month")).agg(F.sum("amount").alias("amount"))
    return months.withColumn("last_year", F.lag("amount", 12).over(Window.orderBy("month"))).filter("last_year is not null")


def yoy_wape(fact: DataFrame) -> DataFrame:
    months = monthly_with_last_year(fact)
    growth = F.broadcast(months.agg(F.try_divide(F.sum("amount"), F.sum("last_year")).alias("growth")))
    error = months.crossJoin(growth).agg(F.try_divide(F.sum(F.abs(F.col("amount") - F.col("last_year") * F.col("growth"))), F.sum("amount")).alias("v"))
    return _one(error, "yoy_wape", F.col("v"), _within(YOY_WAPE))


def last_orders(fact: DataFrame) -> DataFrame:
    return fact.groupBy("customer_code").agg(F.max("order_date").alias("last_order"))


def churn_ratio(fact: DataFrame) -> DataFrame:
    end = F.broadcast(fact.agg(F.max("order_date").alias("end")))
    share = last_orders(fact).crossJoin(end).agg(F.avg((F.col("last_order") < F.date_sub("end", CHURN_DAYS)).cast("double")).alias("v"))
    return _one(share, "churn_ratio", F.col("v"), _within(CHURN))


def anomaly_rate(fact: DataFrame, labels: DataFrame) -> DataFrame:
    rows = labels.select("order_no", "line_no").distinct().agg(F.count("*").alias("a")).crossJoin(fact.agg(F.count("*").alias("n")))
    return _one(rows, "anomaly_rate", F.try_divide(F.col("a"), F.col("n")), _within(ANOMALY))


def large_deal_share(fact: DataFrame) -> DataFrame:
    positive = fact.filter("amount > 0")
    amounts = positive.select(F.lit("amount").alias("column"), F.col("amount").cast("double").alias("v"))
    middle = F.broadcast(exact_quantiles(amounts, (0.5,)).select(F.col("value").alias("middle")))  # one row
    share = positive.crossJoin(middle).agg(F.avg((F.col("amount") > F.col("middle") * LARGE_TIMES).cast("double")).alias("v"))
    return _one(share, "large_deal_share", F.col("v"), _within(LARGE))


def empty_department_months(fact: DataFrame) -> DataFrame:
    sold = F.when(F.col("quantity") > 0, F.struct("department", _month()))
    holes = fact.agg((F.count_distinct(_month()) * F.count_distinct("department") - F.count_distinct(sold)).alias("v"))
    return _one(holes, "empty_department_months", F.col("v"), F.col("raw") == 0)


def orders_per_customer_month(fact: DataFrame) -> DataFrame:
    rate = fact.agg(
        F.try_divide(F.count_distinct(F.when(F.col("quantity") > 0, F.col("order_no"))), F.count_distinct("customer_code") * F.count_distinct(_month())).alias("v")
    )
    return _one(rate, "orders_per_customer_month", F.col("v"), F.col("raw") >= MIN_ORDERS_PER_CUSTOMER_MONTH)


def unlabelled(fact: DataFrame, labels: DataFrame) -> DataFrame:
    return fact.join(labels.select("order_no", "line_no").distinct(), ["order_no", "line_no"], "left_anti")


def below_cost(fact: DataFrame, labels: DataFrame) -> DataFrame:
    rows = unlabelled(fact, labels).filter("quantity > 0 and profit < 0").agg(F.count("*").alias("v"))
    return _one(rows, "below_cost", F.col("v"), F.col("raw") == 0)


#: What the checks read of a ledger.
COLUMNS = ("order_no", "line_no", "order_date", "customer_code", "department", "quantity", "amount", "profit")


def report(fact: DataFrame, labels: DataFrame) -> DataFrame:
    """All seven checks; note says what is expected where one fails.

    The checks read fact several times, so pass a written or kept one with COLUMNS.
    """
    checks = [
        (yoy_wape(fact), f"between {YOY_WAPE[0]} and {YOY_WAPE[1]}"),
        (churn_ratio(fact), f"between {CHURN[0]} and {CHURN[1]}"),
        (anomaly_rate(fact, labels), f"between {ANOMALY[0]} and {ANOMALY[1]}"),
        (large_deal_share(fact), f"between {LARGE[0]} and {LARGE[1]}"),
        (empty_department_months(fact), "0"),
        (orders_per_customer_month(fact), f"at least {MIN_ORDERS_PER_CUSTOMER_MONTH}"),
        (below_cost(fact, labels), "0"),
    ]
    noted = [df.withColumn("note", F.when(~F.col("passed"), F.lit(f"expected {text}"))) for df, text in checks]
    out = noted[0]
    for df in noted[1:]:
        out = out.unionByName(df)
    return out


#: How values are shown: as percentages, with so many digits, or as plain numbers.
PERCENT = {"yoy_wape": 1, "churn_ratio": 1, "anomaly_rate": 2, "large_deal_share": 2}


def shown(name: str, value: float | None) -> str:
    if value is None:
        return "no value"
    return f"{value:.{PERCENT[name]}%}" if name in PERCENT else f"{value:g}"


def format_report(rows: list, remarks: Mapping[str, str] = {}) -> str:
    """Text of collected report rows: a reason follows each failed check; one without a value fails."""
    width = max(len(r["name"]) for r in rows)
    lines = []
    for r in rows:
        remark = f" ({remarks[r['name']]})" if r["name"] in remarks else ""
        lines.append(f"  {'OK' if r['passed'] else 'NG'}  {r['name'].ljust(width)}  {shown(r['name'], r['value'])}{remark}")
        if not r["passed"] and r["note"]:
            lines.append(f"      {r['note']}")
    return "\n".join(lines)
