"""Names, queries and SQL oracles of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, metrics
from ..operators import checks, encoding, explore, landing, profile, quantile, splits
from ..shared import stored
from ..sources import generator, ledger
from . import oracles

FLAGSHIP = "landing_baselines"
STEPS = (1, 3, 5, 10, 15, 20)


def _landing() -> Column:
    return F.col("landing").cast("double")


def _forecast() -> Column:
    return F.col("forecast").cast("double")


class Tables:
    """The derived tables of one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def fact(self) -> DataFrame:
        return ledger.sales(self.spark, self.sf_dir)

    @property
    def labels(self) -> DataFrame:
        return ledger.anomaly_labels(self.fact)

    @cached_property
    def checked(self) -> DataFrame:
        """What the checks and labels read of the ledger, written once for all of them."""
        return stored(self.fact.select(*checks.COLUMNS, "discount", "tax"), "checked")

    @cached_property
    def daily(self) -> DataFrame:
        """Written once: later steps read it several times, and it has a row a group and day."""
        return stored(landing.daily_with_company(self.fact), "daily")

    @cached_property
    def panel(self) -> DataFrame:
        return landing.dense_panel(self.daily)

    @cached_property
    def built(self) -> DataFrame:
        return landing.build(self.daily)

    @cached_property
    def kept(self) -> DataFrame:
        """The usable rows, written once for the folds and what is scored in them."""
        return stored(self.usable, "usable")

    @property
    def usable(self) -> DataFrame:
        return landing.usable(self.built)

    @property
    def validation(self) -> DataFrame:
        panel = self.kept
        return landing.with_folds(panel, landing.month_folds(panel)).filter("role = 'val'")

    @property
    def folded(self) -> DataFrame:
        panel = self.kept
        return encoding.encode(landing.with_folds(panel, landing.month_folds(panel)), encoding.fit_codes(self.daily, ("department",)))

    @property
    def quantiles(self) -> DataFrame:
        panel = self.kept
        return landing.empirical_quantiles(landing.with_folds(panel, landing.month_folds(panel)))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, money: tuple[str, ...] = ("linear", "by_progress")) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show; money to whole units."""
    return df.select(*[F.round(c, 0 if c in money else digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _calendar(t: Tables) -> DataFrame:
    bounds = t.fact.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    return calendar.days_between(bounds).select(F.col("day").alias("date"))


def _scores(t: Tables, *keys: str) -> DataFrame:
    long = landing.long_baselines(t.validation).filter("forecast is not null")
    grouped = long.groupBy("baseline", *keys)
    return grouped.agg(F.count("*").alias("n"), F.round(metrics.wape(_landing(), _forecast()), 6).alias("wape"), F.round(metrics.bias(_landing(), _forecast()), 6).alias("bias"))


def _best(t: Tables) -> DataFrame:
    scores = _scores(t)
    best = scores.agg(F.min_by("baseline", F.struct("wape", "baseline")).alias("baseline"))
    return scores.join(F.broadcast(best), "baseline")  # one row


def _step_folds(t: Tables) -> DataFrame:
    days = [r[0] for r in landing.grid_of(t.daily).select("order_date").collect()]  # business days of the data
    folds = splits.expanding_folds(days, 4, 20, 5)
    rows = [(f.index, f.train_start, f.train_end, f.val_start, f.val_end, f.train_steps, f.val_steps) for f in folds]
    return t.spark.createDataFrame(rows, "fold int, train_start date, train_end date, val_start date, val_end date, train_steps int, val_steps int")


def _fold_counts(t: Tables) -> DataFrame:
    panel = t.kept
    return landing.with_folds(panel, landing.month_folds(panel)).groupBy("fold", "role").agg(F.count("*").alias("n"))


def _pred(q: int) -> Column:
    return F.col(f"pred_q{q}")


def _encoded(t: Tables) -> DataFrame:
    groups = t.daily.select("department").distinct()
    unseen = t.spark.createDataFrame([("no such department",)], "department string")
    return encoding.encode(groups.unionByName(unseen), encoding.fit_codes(groups, ("department",)))


def _coded_dimensions(t: Tables) -> DataFrame:
    """How many customers and products have codes, and whether these are 0, 1, 2 and so on in order of the values."""
    codes = encoding.fit_codes(t.fact, ("customer_code", "product"))
    last = F.lag("value").over(Window.partitionBy("column", F.floor(F.col("code") / 1000)).orderBy("code"))
    return codes.rows.withColumn("last", last).groupBy("column").agg(F.count("*").alias("n"), F.max("code").alias("highest"), F.count_distinct("code").alias("n_codes"), F.count_if(F.col("last") >= F.col("value")).alias("n_disordered"))


def _query(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


PANEL_KEYS = ("department", "month", "step")
FEATURES = ("cal_days", "cal_remaining", "cal_progress", "cal_month", "cal_quarter", "linear", "by_progress")

QUERIES = {
    name: _query(build)
    for name, build in {
        "sales_fact_profile": lambda t: t.fact.groupBy((F.col("quantity") < 0).alias("negative")).agg(
            F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("cost").alias("cost"), F.sum("profit").alias("profit"), F.sum("quantity").alias("quantity")
        ),
        "business_day_grid": lambda t: landing.grid_of(t.daily),
        "calendar_features": lambda t: rounded(calendar.add_calendar_features(_calendar(t)), 9),
        "holiday_flags": lambda t: _calendar(t).select("date", calendar.holiday(F.col("date")).alias("is_holiday")),
        "daily_by_department": lambda t: landing.daily_by_department(t.fact),
        "daily_with_company": lambda t: landing.daily_with_company(t.fact),
        "dense_panel": lambda t: t.panel,
        "landing_cumulative": lambda t: landing.cumulative(t.panel),
        "monthly_lags": lambda t: rounded(landing.monthly_lags(t.panel)),
        "prior_year_progress": lambda t: rounded(landing.with_history(landing.cumulative(t.panel)).select(*PANEL_KEYS, "prev_progress", "prev_cum_amount", "prev_cum_orders")),
        "landing_features": lambda t: rounded(t.built.select(*PANEL_KEYS, *FEATURES, *[c for c in t.built.columns if c.startswith("feat_")])),
        "landing_baselines": lambda t: rounded(t.built.select(*PANEL_KEYS, "landing", "cum_amount", *[c for c in t.built.columns if c.startswith("base_")]), 0),
        "usable_rows": lambda t: t.usable.select(*PANEL_KEYS, "prev_year"),
        "training_target": lambda t: rounded(t.usable.select(*PANEL_KEYS, landing.training_target().alias("target"))),
        "baseline_scores": lambda t: _scores(t),
        "best_baseline": _best,
        "baseline_scores_by_step": lambda t: _scores(t, "step").filter(F.col("step").isin(*STEPS)),
        "baseline_scores_by_group": lambda t: _scores(t, "department"),
        "month_folds": lambda t: landing.month_folds(t.usable),
        "step_folds": _step_folds,
        "fold_split_counts": _fold_counts,
        "point_metrics": lambda t: t.quantiles.groupBy("fold").agg(*[F.round(c, 0 if n in ("mae", "rmse") else 4).alias(n) for n, c in metrics.point_bundle(_landing(), _pred(50)).items()]),
        "pinball_metrics": lambda t: t.quantiles.groupBy("fold").agg(*[F.round(metrics.pinball(_landing(), _pred(q), q / 100), 0).alias(f"pinball_q{q}") for q in (10, 50, 90)]),
        "quantile_metrics": lambda t: t.quantiles.groupBy("fold").agg(*[F.round(c, 0 if n.startswith(("mae", "rmse", "pinball")) else 4).alias(n) for n, c in metrics.quantile_bundle(_landing(), {q / 100: _pred(q) for q in (10, 50, 90)}).items()]),
        "interval_metrics": lambda t: t.quantiles.groupBy("fold").agg(F.round(metrics.coverage(_landing(), _pred(10), _pred(90)), 6).alias("interval_coverage"), F.lit(0.8).alias("interval_nominal")),
        "empirical_quantile_forecast": lambda t: rounded(t.quantiles, 0),
        "forecast_noncrossing": lambda t: t.quantiles.groupBy("fold").agg(F.count_if((_pred(10) <= _pred(50)) & (_pred(50) <= _pred(90))).alias("ordered"), F.count("*").alias("n")),
        "quantile_gbm_forecast": lambda t: rounded(quantile.forecasts(t.folded), 0),
        "gbm_feature_importance": lambda t: quantile.feature_importance(t.folded),
        "encode_groups": _encoded,
        "encode_customers_products": _coded_dimensions,
        "check_yoy_wape": lambda t: checks.yoy_wape(t.fact),
        "check_churn_ratio": lambda t: checks.churn_ratio(t.fact),
        "check_anomaly_rate": lambda t: checks.anomaly_rate(t.fact, t.labels),
        "check_large_deal_share": lambda t: checks.large_deal_share(t.fact),
        "check_empty_department_months": lambda t: checks.empty_department_months(t.fact),
        "check_orders_per_customer_month": lambda t: checks.orders_per_customer_month(t.fact),
        "check_below_cost": lambda t: checks.below_cost(t.fact, t.labels),
        "check_report": lambda t: checks.report(t.checked, ledger.anomaly_labels(t.checked)),
        "granularity_ladder": lambda t: explore.granularity_ladder(t.fact),
        "monthly_naive_scores": lambda t: explore.monthly_naive_scores(t.fact),
        "churned_customers": lambda t: explore.churned_customers(t.fact),
        "churn_signals": lambda t: explore.churn_signals(t.fact),
        "basket_pairs": lambda t: explore.basket_pairs(t.fact),
        "basket_skew": lambda t: explore.basket_skew(t.fact),
        "anomaly_kind_counts": lambda t: explore.anomaly_kind_counts(t.labels),
        "naive_anomaly_fp_rate": lambda t: explore.naive_anomaly_fp_rate(t.fact, t.labels),
        "unlabelled_lines": lambda t: checks.unlabelled(t.fact, t.labels).select("order_no", "line_no", "quantity", "amount"),
        "first_months_extract": lambda t: ledger.first_months(t.fact).select("order_no", "line_no", "order_date", "amount"),
        "legacy_series_summary": lambda t: explore.series_summary(t.fact, landing.grid_of(t.daily)),
        "weekday_order_counts": lambda t: explore.weekday_order_counts(t.fact),
        "column_profile": lambda t: profile.column_profile(t.fact),
        "numeric_summary": lambda t: profile.numeric_summary(t.fact),
        "low_cardinality_values": lambda t: profile.low_cardinality_values(t.fact),
        "date_span": lambda t: profile.date_span(t.fact),
        "generated_ledger": lambda t: generator.generate(t.spark).transactions,
        "generated_customers": lambda t: generator.generate(t.spark).customers,
        "generated_labels": lambda t: generator.generate(t.spark).anomaly_labels,
        "generated_plain_ledger": lambda t: generator.generate_plain(t.spark),
        "duplicate_rows": lambda t: profile.duplicate_rows(t.table("lineitem")),
    }.items()
}

ORACLES = {name: getattr(oracles, name) for name in QUERIES if hasattr(oracles, name)}
