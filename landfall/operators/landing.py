"""The month-landing panel: one row a department (and the company), month and elapsed business day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import business_grid
from ..shared import stored
from ..sources.ledger import require

COMPANY = "ALL"
KEYS = ("department", "month", "step")
QUANTILES = (0.1, 0.5, 0.9)
#: Orders of a day, or customers of a day, that are told apart in one task.
ORDERS_A_TASK = 200_000


def daily_by_department(fact: DataFrame) -> DataFrame:
    return fact.groupBy("department", "order_date").agg(F.sum("amount").alias("amount"), F.count_distinct("order_no").alias("orders"), F.count_distinct("customer_code").alias("customers"))


def daily_with_company(fact: DataFrame) -> DataFrame:
    """Both levels in one pass; distinct counts of the company are counted anew, not added up.

    Lines are summed to orders first, which are written once. Orders and customers are then told apart in
    as many partitions as ORDERS_A_TASK asks for, so a task holds no more of them when there are more orders.
    """
    require(fact, ("department", "order_date", "amount", "order_no", "customer_code"))
    orders = stored(fact.groupBy("department", "order_date", "order_no", "customer_code").agg(F.sum("amount").alias("amount")), "orders")
    parts = max(1, -(-orders.count() // ORDERS_A_TASK))
    levels = F.array(F.struct(F.lit(0).alias("level"), "department"), F.struct(F.lit(1).alias("level"), F.lit(COMPANY).alias("department")))

    def told_apart(key: str, **counts: Column) -> DataFrame:
        """One row for each key of a level's day."""
        dealt = orders.repartition(parts, "order_date", key).select(F.explode(levels).alias("of"), "order_date", key, "amount")
        rows = dealt.groupBy("of.level", "of.department", "order_date", key).agg(F.sum("amount").alias("amount"))
        return rows.select("level", "department", "order_date", *[c.alias(n) for n, c in counts.items()])

    none, one = F.lit(0), lambda key: F.col(key).isNotNull().cast("int")
    by_order = told_apart("order_no", amount=F.col("amount"), orders=one("order_no"), customers=none)
    by_customer = told_apart("customer_code", amount=F.lit(None).cast(by_order.schema["amount"].dataType), orders=none, customers=one("customer_code"))
    days = by_order.unionByName(by_customer).groupBy("level", "department", "order_date")
    return days.agg(*[F.sum(c).alias(c) for c in ("amount", "orders", "customers")]).drop("level")


def grid_of(daily: DataFrame, grid_end: str = "data") -> DataFrame:
    """Business days of the data; grid_end="month_end" goes on to the end of the last month."""
    last = F.max("order_date") if grid_end == "data" else F.last_day(F.max("order_date"))
    return business_grid(daily.agg(F.min("order_date").alias("first"), last.alias("last")))


def dense_panel(daily: DataFrame, grid_end: str = "data") -> DataFrame:
    """Groups times grid with zeros where nothing was sold; landing is the month's total.

    The grid has a row a business day and is broadcast (a century has 25,000).
    """
    grid = F.broadcast(grid_of(daily, grid_end))
    full = daily.select("department").distinct().crossJoin(grid).join(daily, ["department", "order_date"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("amount", "orders", "customers")}
    return full.withColumns(zero).withColumn("landing", F.sum("amount").over(Window.partitionBy("department", "month"))).select(
        "department", "order_date", "month", "step", "cal_days", "amount", "orders", "customers", "landing"
    )


def cumulative(panel: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("department", "month").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"cum_{c}": F.sum(c).over(so_far) for c in ("amount", "orders", "customers")}
    return panel.withColumns(sums | {"cum_max_daily": F.max("amount").over(so_far)})


def monthly_lags(panel: DataFrame) -> DataFrame:
    """Lags and trailing means of month totals; a trailing window counts only when it is full."""
    months = panel.groupBy("department", "month").agg(F.max("landing").alias("landing"))
    order = Window.partitionBy("department").orderBy("month")

    def trailing(a: int, b: int) -> Column:
        frame = order.rowsBetween(a, b)
        return F.when(F.count("landing").over(frame) == 3, F.sum("landing").over(frame))

    return months.select(
        "department", "month", "landing", F.lag("landing", 1).over(order).alias("prev_month"), (trailing(-3, -1) / 3.0).alias("prev_mean3"),
        F.lag("landing", 12).over(order).alias("prev_year"), F.lag("landing", 13).over(order).alias("prev_year_month_before"), F.try_divide(trailing(-3, -1), trailing(-15, -13)).alias("prev_growth3"),
    )


def prior_year(panel: DataFrame) -> DataFrame:
    """The same step of the same month a year before."""
    return panel.select(
        "department", F.add_months("month", 12).alias("month"), "step", F.try_divide("cum_amount", "landing").alias("prev_progress"), F.col("cum_amount").alias("prev_cum_amount"), F.col("cum_orders").alias("prev_cum_orders"),
    )


def with_history(panel: DataFrame) -> DataFrame:
    lags = monthly_lags(panel).drop("landing")
    joined = panel.join(lags, ["department", "month"], "left").join(prior_year(panel), list(KEYS), "left")
    return joined.withColumn("prev_progress", F.when(F.col("prev_progress").isNull() & F.col("prev_year").isNotNull() & F.col("prev_cum_amount").isNull(), 1.0).otherwise(F.col("prev_progress")))


def add_features(history: DataFrame) -> DataFrame:
    c, s, p, k, n = (F.col(x) for x in ("cum_amount", "prev_year", "prev_progress", "step", "cal_days"))
    d = F.try_divide
    return history.withColumns(
        {
            "cal_remaining": n - k, "cal_progress": k / n, "cal_month": F.month("month"), "cal_quarter": F.quarter("month"), "linear": c / k * n, "by_progress": d(c, p),
            "feat_cum": d(c, s), "feat_unit_price_yoy": d(d(c, F.col("cum_orders")), d(s, F.col("prev_cum_orders"))), "feat_orders_yoy": d(F.col("cum_orders"), F.col("prev_cum_orders")),
            "feat_cum_yoy": d(c, F.col("prev_cum_amount")), "feat_max_daily": d(F.col("cum_max_daily"), s), "feat_linear": d(c / k * n, s), "feat_by_progress": d(d(c, p), s),
            "feat_remaining_share": d(c, s) + (1 - k / n), "feat_prev_progress": p, "feat_prev_month": d(F.col("prev_month"), s), "feat_prev_mean3": d(F.col("prev_mean3"), s),
            "feat_prev_year_month_before": d(F.col("prev_year_month_before"), s), "feat_growth3": F.col("prev_growth3"),
        }
    )


@dataclass(frozen=True)
class Baseline:
    """A named expression over the panel; the column is base_<name>."""

    name: str
    description: str
    expression: Callable[[], Column]


BASELINES = (
    Baseline("last_year", "last year's month times recent growth", lambda: F.col("prev_year") * F.coalesce("prev_growth3", F.lit(1.0))),
    Baseline("linear", "month to date carried on at the same pace", lambda: F.col("linear")),
    Baseline("remaining_share", "month to date plus last year's month for the days left", lambda: F.col("cum_amount") + F.col("prev_year") * (1 - F.col("step") / F.col("cal_days"))),
    Baseline("by_progress", "month to date over last year's progress", lambda: F.col("by_progress")),
    Baseline("remaining_actual", "month to date plus what last year's month still brought", lambda: (F.col("cum_amount") + F.col("prev_year") - F.col("prev_cum_amount")).cast("double")),
)


def add_baselines(panel: DataFrame, baselines: tuple[Baseline, ...] = BASELINES) -> DataFrame:
    return panel.withColumns({f"base_{b.name}": b.expression() for b in baselines})


def build(daily: DataFrame, grid_end: str = "data") -> DataFrame:
    """Features and baselines of the panel, which is written once: it is read again for month totals and for the year before."""
    panel = stored(cumulative(dense_panel(daily, grid_end)), "panel")
    return add_baselines(add_features(with_history(panel)))


def usable(panel: DataFrame) -> DataFrame:
    """Rows with a positive month a year before."""
    return panel.filter(F.col("prev_year").isNotNull() & (F.col("prev_year") > 0))


def training_target() -> Column:
    return (F.col("landing") - F.col("cum_amount")) / F.col("prev_year")


def feature_columns(panel: DataFrame) -> list[str]:
    """Numeric columns named cal_ or feat_, and the step."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, kind in panel.dtypes if (c.startswith(("cal_", "feat_")) or c == "step") and kind in numeric]


def long_baselines(panel: DataFrame) -> DataFrame:
    """department, month, step, landing, baseline, forecast: one row a baseline."""
    names = [c for c in panel.columns if c.startswith("base_")]
    return panel.unpivot(["department", "month", "step", "landing"], names, "baseline", "forecast")


def month_folds(panel: DataFrame, n_folds: int = 3, val_months: int = 3) -> DataFrame:
    """fold (oldest 0), train_end, val_start, val_end: folds from the end, fewer where months run out."""
    months = panel.select("month").distinct()
    ranked = months.select("month", (F.row_number().over(Window.orderBy(F.col("month").desc())) - 1).alias("back"), F.count("*").over(Window.partitionBy()).alias("n"))
    blocks = ranked.filter(F.col("back") < n_folds * val_months).groupBy(F.floor(F.col("back") / val_months).alias("b")).agg(F.min("month").alias("val_start"), F.max("month").alias("val_end"), F.max("n").alias("n"), F.count("*").alias("size"))
    fit = blocks.filter((F.col("size") == val_months) & (F.col("n") > (F.col("b") + 1) * val_months))
    kept = F.count("*").over(Window.partitionBy())
    return fit.select((kept - 1 - F.col("b")).cast("int").alias("fold"), F.add_months("val_start", -1).alias("train_end"), "val_start", "val_end")


def with_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The rows of each fold with role train or val; a row of the panel can be in several folds."""
    role = F.when(F.col("month") < F.col("val_start"), "train").when(F.col("month") <= F.col("val_end"), "val")
    return panel.join(F.broadcast(folds.select("fold", "val_start", "val_end"))).withColumn("role", role).filter("role is not null").drop("val_start", "val_end")


def empirical_quantiles(folded: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Forecasts for validation rows from the target's quantiles in training, by department and step.

    Where a department has no such step in training the step over all departments stands in. Quantiles
    are cut at zero, sorted, and carried back to money.
    """
    train = folded.filter("role = 'train'").withColumn("target", training_target())
    of = [F.percentile("target", q).alias(f"q{round(q * 100)}") for q in quantiles]
    names = [f"q{round(q * 100)}" for q in quantiles]
    own = train.groupBy("fold", "department", "step").agg(*of)
    other = train.groupBy("fold", "step").agg(*[c.alias(f"any_{n}") for c, n in zip([F.percentile("target", q) for q in quantiles], names)])
    joined = folded.filter("role = 'val'").join(own, ["fold", "department", "step"], "left").join(other, ["fold", "step"], "left")
    cut = F.array_sort(F.array(*[F.greatest(F.coalesce(n, f"any_{n}"), F.lit(0.0)) for n in names]))
    return joined.withColumn("_q", cut).select(
        "fold", "department", "month", "step", "landing", *[(F.col("cum_amount") + F.col("_q")[i] * F.col("prev_year")).alias(f"pred_{n}") for i, n in enumerate(names)]
    )
