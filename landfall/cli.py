"""Command line: generate, check-data, train-landing, explore and profile over CSV files."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, load_config
from .functions import metrics
from .operators import checks, encoding, explore, landing, profile, quantile
from .session import build_session, ship_package
from .shared import exists, folder, released, stored
from .sources import generator, ledger

REPORT_STEPS = (1, 3, 5, 10, 15, 20)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file on the file system that the path names."""
    system, place = folder(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def generate(spark: SparkSession, config: Config, out: str, force: bool) -> int:
    """transactions, customers and anomaly_labels in out, then the checks of what was written."""
    names = ("transactions", "customers", "anomaly_labels")
    if not force and any(exists(spark, f"{out}/{n}.csv") for n in names):
        print(f"{out} holds a ledger; use --force", file=sys.stderr)
        return 1
    made = generator.generate(spark, config.ledger, config.seed)
    orders = (("order_date", "order_no", "line_no"), ("customer_code",), ("order_no", "line_no"))
    for name, df, keys in zip(names, made, orders):
        ledger.write_csv(df.orderBy(*keys), f"{out}/{name}.csv", force)
    return check_data(spark, f"{out}/transactions.csv", f"{out}/anomaly_labels.csv")


def check_data(spark: SparkSession, transactions: str, labels: str) -> int:
    """The seven checks; every file is read once."""
    fact = stored(ledger.read_csv(spark, transactions).select(*checks.COLUMNS), "checked")
    marks = stored(ledger.read_csv(spark, labels, ledger.LABEL_SCHEMA), "labels")
    rows = checks.report(fact, marks).collect()
    months = checks.monthly_with_last_year(fact).count()
    marked = marks.select("order_no", "line_no").distinct().count()
    print(checks.format_report(rows, {"yoy_wape": f"over {months} months", "anomaly_rate": f"{marked} lines"}))
    released(fact, marks)
    return 0 if all(r["passed"] for r in rows) else 1


def show_exploration(spark: SparkSession, transactions: str, labels: str) -> int:
    """Levels of aggregation, monthly baselines, signs of churn, baskets and what a plain anomaly rule gets wrong."""
    fact = stored(ledger.read_csv(spark, transactions), "fact")
    marks = ledger.read_csv(spark, labels, ledger.LABEL_SCHEMA)
    products = fact.groupBy("product").agg(F.max("discount").alias("most")).collect()  # a row a product
    ceilings = {r["product"]: max(r["most"], 0.0001) for r in products}
    sections = (
        ("levels of aggregation", explore.granularity_ladder(fact)), ("monthly baselines", explore.monthly_naive_scores(fact)), ("signs of churn", explore.churn_signals(fact, ceilings)),
        ("pairs of products", explore.basket_pairs(fact).orderBy(F.desc("n"), "pair").limit(10)), ("skew of pairs", explore.basket_skew(fact)),
        ("kinds of anomalies", explore.anomaly_kind_counts(marks)), ("a negative quantity as an anomaly", explore.naive_anomaly_fp_rate(fact, marks)),
    )
    for title, df in sections:
        print(f"\n{title}")
        df.show(20, truncate=False)
    released(fact)
    return 0


def show_profile(spark: SparkSession, path: str) -> int:
    """Shape, columns, first rows, numbers, categories, dates and repeated rows; the file is read once."""
    df = stored(ledger.sniff_csv(spark, path), "profiled")
    sections = (
        ("1. shape", profile.shape(df)), ("2. columns", profile.column_profile(df)), ("3. first rows", profile.head(df)), ("4. numbers", profile.numeric_summary(df)),
        ("5. columns with few values", profile.low_cardinality_values(df).orderBy("column", "value")), ("6. dates", profile.date_span(df)), ("7. repeated rows", profile.duplicate_rows(df)),
    )
    for title, part in sections:
        print(f"\n{title}")
        part.show(1000, truncate=False)
    released(df)
    return 0


def _bundle(df: DataFrame, *keys: str) -> list[dict]:
    y, f = F.col("landing").cast("double"), F.col("forecast").cast("double")
    scored = df.filter("forecast is not null").groupBy("method", *keys).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in metrics.point_bundle(y, f).items()])
    return [r.asDict() for r in scored.orderBy("method", *keys).collect()]


def summary(validation: DataFrame, predictions: DataFrame) -> dict:
    """Scores overall, by step and by group; the best baseline is chosen overall, the first by name of equal ones."""
    keys = ["department", "month", "step", "landing"]
    base = landing.long_baselines(validation).withColumnRenamed("baseline", "method").select(*keys, "method", "forecast")
    model = predictions.select(*keys, F.lit("model").alias("method"), F.col("pred_q50").alias("forecast"))
    both = base.unionByName(model)
    overall = {r["method"]: r for r in _bundle(both)}
    best = min((m for m in overall if m != "model"), key=lambda m: (overall[m]["wape"], m))
    bounds = sorted((c for c in predictions.columns if c.startswith("pred_q")), key=lambda c: int(c.removeprefix("pred_q")))
    low, high = bounds[0], bounds[-1]
    covered = predictions.agg(metrics.coverage(F.col("landing").cast("double"), F.col(low), F.col(high))).first()[0]
    return {
        "overall": overall, "best_baseline": best, "improvement": 1 - overall["model"]["wape"] / overall[best]["wape"], "interval_coverage": covered,
        "by_step": [r for r in _bundle(both.filter(F.col("step").isin(*REPORT_STEPS)), "step") if r["method"] in ("model", best)],
        "by_group": [r for r in _bundle(both, "department") if r["method"] in ("model", best)],
    }


def train_landing(spark: SparkSession, config: Config, transactions: str, out: str, model: str | None, force: bool) -> int:
    """Report (JSON) and predictions (Parquet) in out; the final models with codes and metadata in model, if given."""
    if exists(spark, out) and not force:
        print(f"{out} exists; use --force", file=sys.stderr)
        return 1
    cfg = config.landing
    panel = stored(landing.usable(landing.build(landing.daily_with_company(ledger.read_csv(spark, transactions)), cfg.grid_end)), "panel")
    folds = landing.month_folds(panel, cfg.n_folds, cfg.val_months).collect()  # a row a fold
    if not folds:
        months = panel.select("month").distinct().count()
        print(f"{months} months are too few for a fold with {cfg.val_months} months to validate; take a longer period", file=sys.stderr)
        return 1
    folded = landing.with_folds(panel, spark.createDataFrame(folds))
    codes = encoding.fit_codes(panel, ("department",))
    predictions = stored(quantile.forecasts(encoding.encode(folded, codes), cfg.quantiles), "predictions")
    report = summary(folded.filter("role = 'val'"), predictions)
    predictions.write.mode("overwrite").parquet(f"{out}/landing_predictions.parquet")
    _write_text(spark, f"{out}/landing_metrics.json", json.dumps(report, ensure_ascii=False, default=str, indent=1))
    if model:
        rows = encoding.encode(panel, codes).withColumn("target", landing.training_target())
        features = landing.feature_columns(rows)
        frame = rows.select("target", *features).toPandas().sort_values(["target", *features])  # a row a department and business day
        models = {q: quantile.QuantileGBM(q, features).fit(frame, frame["target"].to_numpy()) for q in cfg.quantiles}
        last = panel.agg(F.min("month"), F.max("month")).first()
        metadata = {"trained": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "rows": len(frame), "first_month": str(last[0]), "last_month": str(last[1]), "features": features, "quantiles": list(cfg.quantiles), "scores": report["overall"]["model"]}
        quantile.save(quantile.Artifact(models, encoding.codes_to_dict(codes), metadata), model)
    print(f"model WAPE {report['overall']['model']['wape']:.4f}, best baseline {report['best_baseline']} {report['overall'][report['best_baseline']]['wape']:.4f}")
    released(panel, predictions)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="landfall")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate")
    make.add_argument("out")
    make.add_argument("--force", action="store_true")
    check = commands.add_parser("check-data")
    check.add_argument("transactions")
    check.add_argument("labels")
    train = commands.add_parser("train-landing")
    train.add_argument("transactions")
    train.add_argument("out", nargs="?")
    train.add_argument("--save-model")
    train.add_argument("--force", action="store_true")
    look = commands.add_parser("explore")
    look.add_argument("transactions", nargs="?")
    look.add_argument("labels", nargs="?")
    show = commands.add_parser("profile")
    show.add_argument("path")
    args = parser.parse_args(argv)
    try:
        config = load_config(args.config)
    except (FileNotFoundError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    spark = SparkSession.getActiveSession() or build_session(app="landfall")
    ship_package(spark)
    if args.command == "generate":
        return generate(spark, config, args.out, args.force)
    if args.command == "check-data":
        return check_data(spark, args.transactions, args.labels)
    if args.command == "train-landing":
        return train_landing(spark, config, args.transactions, args.out or config.paths.reports_dir, args.save_model, args.force)
    if args.command == "explore":
        raw = config.paths.raw_dir
        return show_exploration(spark, args.transactions or f"{raw}/transactions.csv", args.labels or f"{raw}/anomaly_labels.csv")
    return show_profile(spark, args.path)


if __name__ == "__main__":
    sys.exit(main())
