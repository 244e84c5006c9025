from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from landfall.operators import checks
from landfall.sources import generator, ledger
from landfall.sources.generator import LedgerConfig, generate

SMALL = LedgerConfig(date(2023, 1, 1), date(2024, 12, 31), 40, 2, 0.25, 0.20)


@pytest.fixture(scope="module")
def made(spark):
    made = generate(spark, SMALL, 7)
    return generator.Ledger(*[df.persist() for df in made])


def test_schema_and_unique_keys(made):
    fact = made.transactions
    assert [(f.name, f.dataType) for f in fact.schema] == [(f.name, f.dataType) for f in ledger.LEDGER_SCHEMA]
    assert fact.count() == fact.select("order_no", "line_no").distinct().count() > 3000
    assert fact.filter("order_no is null or quantity is null or unit_price is null or quantity = 0").count() == 0


def test_money_is_exact(made):
    wrong = "amount <> unit_price * quantity or cost <> unit_cost * quantity or profit <> amount - cost or unit_price % 10 <> 0"
    assert made.transactions.filter(wrong).count() == 0


def test_business_days_only(made):
    bounds = made.transactions.agg(F.min("order_date"), F.max("order_date")).first()
    assert SMALL.start <= bounds[0] and bounds[1] <= SMALL.end
    assert made.transactions.filter(~generator.business_day(F.col("order_date"))).count() == 0


def test_a_representative_has_one_department(made):
    reps = made.transactions.groupBy("sales_rep").agg(F.count_distinct("department").alias("n"))
    assert reps.filter("n > 1").count() == 0 and made.transactions.select("department").distinct().count() == 3


def test_nothing_sold_below_cost_unless_labelled(made):
    assert checks.below_cost(made.transactions, made.anomaly_labels).first()["value"] == 0
    errors = made.transactions.join(made.anomaly_labels.filter("kind = 'discount_error'"), ["order_no", "line_no"])
    assert errors.filter("profit / quantity >= 0").count() == 0


def test_labels_name_lines(made):
    labels = made.anomaly_labels
    assert {r[0] for r in labels.select("kind").distinct().collect()} <= {"quantity_typo", "discount_error", "push_sale"}
    assert labels.join(made.transactions, ["order_no", "line_no"], "left_anti").count() == 0


def test_cancellations_undo_a_sale_within_bounds(made):
    fact = made.transactions.withColumn("tail", F.substring("order_no", 3, 100))
    sold = fact.filter("order_no like 'SO%'").select("tail", "line_no", F.col("order_date").alias("sold"), F.col("quantity").alias("q"))
    for prefix, days in (("CN", generator.CANCEL_DAYS), ("RT", generator.RETURN_DAYS)):
        back = fact.filter(F.col("order_no").startswith(prefix))
        both = back.join(sold, ["tail", "line_no"])
        assert both.count() == back.count() > 0
        assert both.filter((F.datediff("order_date", "sold") > days) | (F.col("order_date") <= F.col("sold")) | (F.abs("quantity") > F.col("q"))).count() == 0
    assert fact.filter("order_no like 'CN%'").join(sold, ["tail", "line_no"]).filter("quantity + q <> 0").count() == 0


def test_customers_tell_nothing_of_leaving(made):
    assert made.customers.columns == ["customer_code", "customer_name", "customer_area", "branch", "entry_month"]
    assert made.customers.count() == SMALL.n_customers


def test_seed_decides(spark):
    cfg = LedgerConfig(date(2023, 1, 1), date(2023, 6, 30), 20, 2)
    rows = lambda seed, parts: sorted(generate(spark, cfg, seed).transactions.repartition(parts).collect())
    assert rows(3, 1) == rows(3, 5) != rows(4, 1)


def test_poisson_has_its_mean(spark):
    d = generator.Draws(1)
    c = F.col("id")
    for mean in (0.5, 7.0, 25.0, 60.0):
        got = spark.range(4000).withColumns({"u": d.uniform("u", c), "z": d.normal("z", c)}).agg(F.avg(generator.poisson(F.col("u"), F.col("z"), F.lit(mean)))).first()[0]
        assert abs(got - mean) < 6 * (mean / 4000) ** 0.5 + 0.01


def test_default_ledger_meets_the_checks(spark):
    made = generate(spark)
    fact, labels = made.transactions.persist(), made.anomaly_labels.persist()
    failed = [r for r in checks.report(fact, labels).collect() if not r["passed"]]
    assert not failed


@pytest.mark.parametrize("bad", [{"end": date(2021, 1, 1)}, {"new_customer_ratio": 0.5, "churn_ratio": 0.4}, {"reps_per_department": 21}, {"n_customers": 0}])
def test_bad_settings_are_errors(bad):
    with pytest.raises(ValueError):
        LedgerConfig(**bad)


def test_plain_ledger(spark):
    """The simpler ledger has no numbers, nothing negative, nothing below cost, and the same customers all along."""
    fact = generator.generate_plain(spark, SMALL, 7).persist()
    assert not {"order_no", "line_no"} & set(fact.columns) and fact.count() > 3000
    assert fact.filter("quantity < 1 or profit < 0 or amount <> unit_price * quantity").count() == 0
    assert fact.filter(~generator.business_day(F.col("order_date"))).count() == 0
    years = fact.groupBy("customer_code").agg(F.count_distinct(F.year("order_date")).alias("n"))
    assert years.filter("n = 2").count() > 0.9 * SMALL.n_customers
