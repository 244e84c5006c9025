from __future__ import annotations

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from landfall.functions import calendar, metrics, quantiles, scalars
from landfall.operators import checks, encoding, explore, landing, profile, splits
from landfall.sources import ledger

DAY = dt.date.fromisoformat


def flags(spark, days):
    df = spark.createDataFrame([(DAY(d),) for d in days], "d date")
    return [r[0] for r in df.orderBy("d").select(calendar.holiday(F.col("d")).cast("int")).collect()]


def test_holidays(spark):
    assert flags(spark, ["2026-05-03", "2026-05-04", "2026-05-05", "2026-05-06", "2026-05-07"]) == [1, 1, 1, 1, 0]
    assert flags(spark, ["2025-12-29", "2025-12-30", "2026-01-03", "2026-01-04"]) == [0, 1, 1, 0]
    assert flags(spark, ["2024-01-08", "2024-02-12", "2024-03-20", "2024-09-22", "2024-09-23", "2026-09-22"]) == [1, 1, 1, 1, 1, 0]


def test_calendar_features(spark):
    row = calendar.add_calendar_features(spark.createDataFrame([(DAY("2026-08-15"),)], "date date")).first()
    assert (row.cal_dow, row.cal_doy, row.cal_is_weekend) == (6, 227, 1)
    assert row.cal_yearly_sin_1 == pytest.approx(math.sin(2 * math.pi * 227 / 365.25))


def test_business_days(spark):
    grid = calendar.business_grid(spark.createDataFrame([(DAY("2022-01-01"), DAY("2024-12-31"))], "first date, last date"))
    assert grid.count() == 733
    assert grid.agg(F.min("order_date"), F.max("order_date")).first()[:] == (DAY("2022-01-04"), DAY("2024-12-27"))


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 12.0), (0.0, 3.0), (90.0, 85.0)], "y double, f double")
    y, f = F.col("y"), F.col("f")
    row = df.agg(metrics.wape(y, f).alias("w"), metrics.bias(y, f).alias("b"), metrics.mae(y, f).alias("m")).first()
    assert row.w == pytest.approx(0.10) and row.b == 0 and row.m == pytest.approx(10 / 3)
    cover = spark.createDataFrame([(5.0,), (15.0,), (25.0,)], "y double").agg(metrics.coverage(y, F.lit(0.0), F.lit(10.0))).first()[0]
    assert cover == pytest.approx(1 / 3)
    zero = spark.createDataFrame([(0.0, 1.0)], "y double, f double").agg(metrics.wape(y, f)).first()[0]
    assert zero is None
    with pytest.raises(ValueError):
        metrics.pinball(y, f, 1.0)
    with pytest.raises(KeyError):
        metrics.quantile_bundle(y, {0.1: f})
    many = spark.createDataFrame([(10.0, 5.0, 10.0, 15.0), (20.0, 15.0, 19.0, 25.0)], "y double, a double, b double, c double")
    got = many.agg(*[c.alias(n) for n, c in metrics.quantile_bundle(y, {0.1: F.col("a"), 0.5: F.col("b"), 0.9: F.col("c")}).items()]).first()
    assert got.interval_coverage == 1.0 and got.interval_nominal == 0.8 and got.wape == pytest.approx(1 / 30)


def test_folds():
    days = [DAY("2025-01-01") + dt.timedelta(days=i) for i in range(365)]
    folds = splits.expanding_folds(days, 3, 30, 5)
    assert [f.index for f in folds] == [0, 1, 2] and folds[-1].val_end == days[-1]
    for f in folds:
        assert f.train_start == days[0] and (f.val_start - f.train_end).days == 6
    for bad in ((0, 30, 0), (3, 0, 0), (3, 30, -1), (13, 30, 0)):
        with pytest.raises(ValueError):
            splits.expanding_folds(days, *bad)


@pytest.fixture(scope="module")
def fact(spark):
    return ledger.sales(spark, "/root/testdata/sf0.001").persist()


def test_panel(spark, fact):
    panel = landing.build(landing.daily_with_company(fact)).persist()
    assert panel.count() == panel.select("department", "month", "step").distinct().count()
    by_level = panel.groupBy("order_date").agg(F.sum(F.when(F.col("department") == "ALL", F.col("amount")).otherwise(-F.col("amount"))).alias("d"))
    assert by_level.filter("d <> 0").count() == 0
    spans = panel.groupBy("department", "month").agg(F.min("step").alias("a"), F.max("step").alias("b"), F.max("cal_days").alias("n")).filter("a <> 1 or b <> n")
    assert spans.count() == 0
    last = panel.filter("step = cal_days and base_remaining_share is not null").filter(F.abs(F.col("base_remaining_share") - F.col("cum_amount")) > 1)
    assert last.count() == 0
    assert "feat_cum" in landing.feature_columns(panel) and "landing" not in landing.feature_columns(panel)


def test_no_leak(spark, fact):
    """Sales after the day make no difference to its features; sales before do."""
    month, step = DAY("2000-06-01"), 8
    day = landing.grid_of(landing.daily_with_company(fact)).filter((F.col("month") == F.lit(month)) & (F.col("step") == step)).first().order_date

    def features(rows):
        panel = landing.build(landing.daily_with_company(rows))
        row = panel.filter((F.col("month") == F.lit(month)) & (F.col("step") == step) & (F.col("department") == "ALL")).first().asDict()
        return {k: v for k, v in row.items() if k.startswith(("feat_", "cal_", "base_"))}, row["landing"]

    inflated = lambda cond: fact.withColumn("amount", F.when(cond, F.col("amount") * 10).otherwise(F.col("amount")))
    before, total = features(fact)
    after, after_total = features(inflated(F.col("order_date") > F.lit(day)))
    changed, _ = features(inflated((F.col("order_date") <= F.lit(day)) & (F.trunc("order_date", "MM") == F.lit(month))))
    assert after == before and after_total != total and changed != before


def test_month_end_grid(spark, fact):
    daily = landing.daily_with_company(fact)
    assert landing.grid_of(daily, "month_end").count() >= landing.grid_of(daily).count()


def test_required_columns(spark, fact):
    with pytest.raises(KeyError):
        landing.daily_with_company(fact.drop("amount"))
    with pytest.raises(KeyError):
        encoding.fit_codes(fact, ("nope",))


def test_encoder(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), ("c", None), ("b", 10)], "g string, h int")
    codes = encoding.fit_codes(df, ("g", "h"))
    again = encoding.codes_from_dict(spark, encoding.codes_to_dict(codes))
    for table in (codes, again):
        rows = encoding.encode(spark.createDataFrame([("a", 10), ("c", 9), ("z", 1), (None, None)], "g string, h int"), table).collect()
        assert sorted((r.feat_g_code, r.feat_h_code) for r in rows) == [(-1, -1), (-1, -1), (0, 0), (2, 1)]
    many = spark.range(5000).selectExpr("cast(id as string) as k")
    coded = encoding.encode(many, encoding.fit_codes(many, ("k",)))
    assert [r.k for r in coded.orderBy("feat_k_code").collect()] == sorted(str(i) for i in range(5000))
    assert {r.feat_k_code for r in coded.collect()} == set(range(5000))


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [("a", float(rng.randrange(50))) for _ in range(999)] + [("b", rng.random()) for _ in range(20000)] + [("c", None), ("d", 3.0), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "column string, v double").repartition(7)
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r.column, r.q): r.value for r in quantiles.exact_quantiles(df, qs).collect()}
    values = {}
    for c, v in rows:
        values.setdefault(c, []).append(v)
    assert got == {(c, q): pytest.approx(float(np.quantile(values[c], q)), rel=1e-12) for c in "abde" for q in qs}


def test_scalars():
    assert scalars.as_date(dt.datetime(2024, 1, 2, 3)) == scalars.as_date(DAY("2024-01-02")) == DAY("2024-01-02") and scalars.as_float(3) == 3.0
    for bad in (None, "2024-01-02", 3):
        with pytest.raises(TypeError):
            scalars.as_date(bad)
    for bad in (None, "3", True, DAY("2024-01-02")):
        with pytest.raises(TypeError):
            scalars.as_float(bad)


def test_evaluate(spark):
    y, f = F.col("y"), F.col("f")
    whole = spark.createDataFrame([(10.0, 12.0), (0.0, 3.0), (90.0, 85.0)], "y double, f double")
    assert metrics.evaluate(whole, metrics.point_bundle(y, f), y, f)["wape"] == pytest.approx(0.10)
    with pytest.raises(ValueError):
        metrics.evaluate(whole.limit(0), metrics.point_bundle(y, f), y, f)
    with pytest.raises(ValueError):
        metrics.evaluate(whole.unionByName(spark.createDataFrame([(1.0, None)], "y double, f double")), metrics.point_bundle(y, f), y, f)


def test_split(spark):
    days = [DAY("2025-01-01") + dt.timedelta(days=i) for i in range(100)]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, value int")
    for fold in splits.expanding_folds(days, 2, 10, 3):
        train, val = splits.split(df, fold)
        assert train.count() == fold.train_steps and val.count() == fold.val_steps
        assert train.agg(F.max("date")).first()[0] < val.agg(F.min("date")).first()[0]


def test_bounds_hold_for_the_value_itself(spark):
    """A value that only rounding would bring within its bounds fails."""
    df = spark.createDataFrame([(0.2500004,), (0.25,), (0.1499999,), (0.15,)], "v double")
    rows = checks._one(df, "x", F.col("v"), checks._within(checks.YOY_WAPE)).collect()
    assert [(r.value, r.passed) for r in rows] == [(0.25, False), (0.25, True), (0.15, False), (0.15, True)]


def test_checks_fail_when_broken(spark, fact):
    labels = ledger.anomaly_labels(fact)
    hole = fact.filter(~((F.col("department") == "ASIA") & (F.trunc("order_date", "MM") == F.lit(DAY("1998-07-01")))))
    assert checks.empty_department_months(hole).first().value > checks.empty_department_months(fact).first().value
    cheap = fact.withColumn("profit", F.lit(-1000).cast("bigint"))
    assert not checks.below_cost(cheap, labels).first().passed
    text = checks.format_report(checks.report(fact, labels).collect())
    assert "below_cost" in text and "NG" in text and "%" in text and checks.shown("yoy_wape", 0.1984) == "19.8%"


def test_unknown_product(spark, fact):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        fact.limit(5).select(explore.ceiling_of(F.lit("no such product"))).collect()


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, DAY("2024-01-05")), ("b", 2, None)], "k string, n int, d date")
    path = str(tmp_path / "x")
    ledger.write_csv(rows, path)
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        ledger.write_csv(rows, path)
    ledger.write_csv(rows, path, force=True, one_file=True)
    assert {tuple(r) for r in ledger.read_csv(spark, path, rows.schema).collect()} == {tuple(r) for r in rows.collect()}
    (tmp_path / "y.csv").write_text("a;b\n1;x\n2;y\n")
    assert ledger.sniff_csv(spark, str(tmp_path / "y.csv")).columns == ["a", "b"]
    (tmp_path / "z.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        ledger.sniff_csv(spark, str(tmp_path / "z.csv"))


def test_profile(spark):
    df = spark.createDataFrame([(1, "x", 0.0, DAY("2024-01-01"), "2024-02-01"), (1, None, -0.0, DAY("2024-01-03"), "no"), (2, "x", 1.5, DAY("2024-01-03"), None), (2, "x", 1.5, DAY("2024-01-03"), None)], "n int, s string, f double, d date, my_day string")
    rows = {r.column: r for r in profile.column_profile(df).collect()}
    assert rows["s"].n_unique == 2 and rows["s"].n_nulls == 1 and rows["n"].n_unique == 2 and rows["f"].n_unique == 2 and rows["s"].null_percent == 25.0
    assert profile.duplicate_rows(df).first().n_duplicates == 1
    assert profile.date_columns(df) == ["d", "my_day"]
    spans = {r.column: r for r in profile.date_span(df).collect()}
    assert (spans["d"].n_days, spans["d"].n_present, spans["d"].n_missing) == (3, 2, 1) and spans["my_day"].n_present == 1
    assert sorted(((r.column, r.value) for r in profile.low_cardinality_values(df, limit=2).collect()), key=str) == sorted([("n", "1"), ("n", "2"), ("s", "x"), ("s", None), ("f", "0.0"), ("f", "1.5"), ("d", "2024-01-01"), ("d", "2024-01-03")], key=str)
    assert {r.column: r.q50 for r in profile.numeric_summary(df).collect()} == {"n": 1.5, "f": 0.75}
    assert profile.shape(df).first()[:] == (4, 5) and profile.head(df, 2).count() == 2
    none = df.limit(0)
    assert {r.n_unique for r in profile.column_profile(none).collect()} == {0} and profile.numeric_summary(none).count() == 0 and profile.duplicate_rows(none).first()[:] == (0, 0, 0)


def test_daily_holds_few_orders_a_task(spark, fact, monkeypatch):
    """Partitions follow the number of orders and of lines, no row is expanded by kinds of counts, and results stay."""
    rows = [(d, day, amount, order, customer) for day in (DAY("2024-01-01"), None) for d, amount, order, customer in [("a", 1, 1, 7), ("b", 2, 1, 7), ("a", 3, 2, None), (None, 4, None, 8), ("ALL", 5, 3, 8), ("a", 6, 1, 9), ("c", None, 4, 4)]]
    odd = spark.createDataFrame(rows, "department string, order_date date, amount bigint, order_no bigint, customer_code bigint")
    monkeypatch.setattr(landing, "ORDERS_A_TASK", 5)
    monkeypatch.setattr(ledger, "LINES_A_TASK", 100)
    daily = landing.daily_with_company(odd)
    want = {}
    for level in (0, 1):
        for d, day, amount, order, customer in rows:
            amounts, orders, customers = want.setdefault((level, "ALL" if level else d, day), ([], set(), set()))
            amounts += [amount] * (amount is not None)
            orders |= {order} - {None}
            customers |= {customer} - {None}
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, daily.collect()), key=key) == sorted([(d, day, sum(a) if a else None, len(o), len(c)) for (_, d, day), (a, o, c) in want.items()], key=key)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and ", 3), REPARTITION_BY_NUM" in plan
    dealt = ledger.sales(spark, "/root/testdata/sf0.001")
    assert ", 60), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.exceptAll(fact).count() == fact.exceptAll(dealt).count() == 0


def test_many_lines_are_read_in_parts(spark, fact, monkeypatch, tmp_path):
    """A task that deals lines out reads no more of them when there are more."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name in ledger.TABLES:
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        table.coalesce(1).write.option("parquet.block.size", 65536).parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(ledger, "LINES_A_TASK", 100)
    asked = []
    monkeypatch.setattr(ledger, "split_finely", lambda *a, real=ledger.split_finely: asked.append(a[1:]) or real(*a))
    try:
        dealt = ledger.sales(spark, str(tmp_path))
        assert asked == [(f"{tmp_path}/lineitem.parquet", 60)] and spark.conf.get("spark.sql.files.maxPartitionBytes") == str(1 << 20)
        assert dealt.exceptAll(fact).count() == fact.exceptAll(dealt).count() == 0
        ledger.split_finely(spark, str(tmp_path), 1)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(1 << 20)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_dimensions_are_dealt_like_lines(spark, fact, monkeypatch):
    """No join of many lines is left to a fixed number of partitions, and customers meet orders instead of lines."""
    monkeypatch.setattr(ledger, "LINES_A_TASK", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        dealt = ledger.sales(spark, "/root/testdata/sf0.001")
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        for key in ("l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "l_partkey", "p_partkey"):
            assert re.search(rf"hashpartitioning\({key}#\d+L?, 60\), REPARTITION_BY_NUM", plan), key
        assert not re.search(r"hashpartitioning\((l_|o_)\w+#\d+L?, \d+\), ENSURE_REQUIREMENTS", plan)
        assert dealt.exceptAll(fact).count() == fact.exceptAll(dealt).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
