from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from landfall import cli
from landfall.config import load_config
from landfall.operators import quantile
from landfall.sources import ledger


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ledger")
    fact = ledger.sales(spark, "/root/testdata/sf0.001")
    known = {f.name for f in ledger.LEDGER_SCHEMA}
    wide = fact.select(*[(F.col(f.name) if f.name in fact.columns and f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in ledger.LEDGER_SCHEMA])
    ledger.write_csv(wide, str(folder / "sales"))
    ledger.write_csv(ledger.anomaly_labels(fact), str(folder / "labels"))
    return folder


def test_check_data(files, capsys):
    assert cli.main(["check-data", str(files / "sales"), str(files / "labels")]) == 1
    assert "below_cost" in capsys.readouterr().out


def test_train_landing(files):
    out = str(files / "out")
    assert cli.main(["train-landing", str(files / "sales"), out, "--save-model", str(files / "model")]) == 0
    report = json.loads((files / "out" / "landing_metrics.json").read_text())
    assert report["best_baseline"] in report["overall"] and 0 <= report["interval_coverage"] <= 1
    artifact = quantile.load(str(files / "model"))
    assert set(artifact.models) == {0.1, 0.5, 0.9} and "ALL" in artifact.codes["values"]["department"] and artifact.metadata["rows"] > 0
    assert "feat_department_code" in artifact.models[0.5].features
    assert cli.main(["train-landing", str(files / "sales"), out]) == 1


def test_train_without_folds(files, tmp_path, capsys):
    settings = tmp_path / "many.yaml"
    settings.write_text("landing: {val_months: 500}\n")
    assert cli.main(["--config", str(settings), "train-landing", str(files / "sales"), str(tmp_path / "none")]) == 1
    assert "too few" in capsys.readouterr().err and not (tmp_path / "none").exists()


def test_outer_quantiles_by_number(spark):
    rows = [("a", None, 1, 10, 5.0, 9.0, 10.0, 20.0)]
    predictions = spark.createDataFrame(rows, "department string, month date, step int, landing bigint, pred_q5 double, pred_q10 double, pred_q50 double, pred_q90 double")
    validation = spark.createDataFrame([("a", None, 1, 10, 8.0)], "department string, month date, step int, landing bigint, base_x double")
    assert cli.summary(validation, predictions)["interval_coverage"] == 1.0
    low = predictions.withColumn("landing", F.lit(7).cast("bigint"))
    assert cli.summary(validation, low)["interval_coverage"] == 1.0
    assert cli.summary(validation, predictions.drop("pred_q5", "pred_q10", "pred_q90"))["interval_coverage"] == 1.0


def test_explore_and_profile(files, capsys):
    assert cli.main(["explore", str(files / "sales"), str(files / "labels")]) == 0
    out = capsys.readouterr().out
    assert "levels of aggregation" in out and "fp_rate" in out
    assert cli.main(["profile", str(files / "labels")]) == 0
    out = capsys.readouterr().out
    assert all(f"{k}. " in out for k in range(1, 8)) and "push_sale" in out


def test_generate(tmp_path, capsys):
    settings = tmp_path / "small.yaml"
    settings.write_text("seed: 7\nledger: {start: 2023-01-01, end: 2023-04-30, n_customers: 15, reps_per_department: 2}\n")
    args = ["--config", str(settings), "generate", str(tmp_path / "out")]
    assert cli.main(args) in (0, 1)  # four months cannot meet every check
    assert "below_cost" in capsys.readouterr().out
    assert all((tmp_path / "out" / f"{n}.csv").exists() for n in ("transactions", "customers", "anomaly_labels"))
    assert cli.main(args) == 1 and "--force" in capsys.readouterr().err
    assert cli.main([*args, "--force"]) in (0, 1)


def test_config(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))
    good = tmp_path / "good.yaml"
    good.write_text("landing:\n  n_folds: 2\n  quantiles: [0.2, 0.5, 0.8]\n")
    assert load_config(str(good)).landing.quantiles == (0.2, 0.5, 0.8)
    good.write_text("paths: {raw_dir: x/raw}\n")
    assert load_config(str(good)).paths.raw_dir == "x/raw" and load_config(str(good)).paths.model_dir == "models"
    for text in ("other: {}\n", "landing: {foo: 1}\n", "landing: {n_folds: 0}\n", "landing: {quantiles: [0.1]}\n", "landing: {grid_end: never}\n", "ledger: {foo: 1}\n", "ledger: {end: 2020-01-01}\n", "ledger: {churn_ratio: 0.9}\n"):
        good.write_text(text)
        with pytest.raises(ValueError):
            load_config(str(good))
    assert cli.main(["--config", str(tmp_path / "none.yaml"), "profile", "x"]) == 1
