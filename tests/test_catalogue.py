from __future__ import annotations

import pytest
from oracle import connect, same

from landfall.plans import catalogue

SF = "/root/testdata/sf0.001"
QUICK = ["daily_with_company", "landing_features", "landing_baselines", "baseline_scores_by_group", "month_folds", "step_folds", "empirical_quantile_forecast", "encode_groups", "encode_customers_products", "quantile_metrics", "numeric_summary", "low_cardinality_values", "date_span", "duplicate_rows", "check_large_deal_share", "check_report", "granularity_ladder", "churn_signals", "basket_skew", "column_profile", "holiday_flags"]


#: Models and hashed draws; tests of their own hold them.
NO_SQL = {"quantile_gbm_forecast", "gbm_feature_importance", "generated_ledger", "generated_customers", "generated_labels", "generated_plain_ledger"}


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == NO_SQL


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), connect(SF), catalogue.ORACLES[name])


def test_driver_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """Dimensions are broadcast, columns pruned, and the running sums share one window."""
    tables = catalogue.Tables(spark, SF)
    from landfall.operators import landing

    plan = landing.daily_by_department(tables.fact)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "o_totalprice" not in plan
    running = landing.cumulative(tables.panel)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Window") and "cum_amount" in line for line in running.splitlines()) == 1
