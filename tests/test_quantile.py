from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from landfall.operators import quantile
from landfall.plans import catalogue


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"a": rng.normal(size=600), "b": rng.normal(size=600)})
    frame.loc[::50, "b"] = np.nan
    target = np.maximum(0, 10 + 3 * frame["a"] - 2 * frame["b"].fillna(0) + rng.normal(size=600)).to_numpy()
    return frame, target, {q: quantile.QuantileGBM(q, ["a", "b"]).fit(frame, target) for q in (0.1, 0.5, 0.9)}


def test_quantiles_hold(toy):
    frame, target, models = toy
    below = {q: float((target <= m.predict(frame)).mean()) for q, m in models.items()}
    assert below[0.1] < 0.25 and 0.35 < below[0.5] < 0.65 and below[0.9] > 0.75
    assert np.abs(models[0.5].predict(frame) - target).mean() < np.abs(np.median(target) - target).mean() / 2


def test_models_have_the_size_of_the_reference(toy):
    frame, target, models = toy
    for model in models.values():
        assert len(model.trees) == 300
        leaves = [sum("value" in node for node in tree) for tree in model.trees]
        assert max(leaves) == 15
    again = quantile.QuantileGBM(0.5, ["a", "b"]).fit(frame, target)
    assert np.array_equal(again.predict(frame), models[0.5].predict(frame))


def test_contract(toy, tmp_path):
    frame, _, models = toy
    with pytest.raises(RuntimeError):
        quantile.QuantileGBM(0.5, ["a"]).predict(frame)
    with pytest.raises(KeyError):
        models[0.5].predict(frame.drop(columns="b"))
    with pytest.raises(KeyError):
        quantile.importance(models, 0.3)
    counts = [n for _, n in quantile.importance(models, 0.5)]
    assert counts == sorted(counts, reverse=True)
    with pytest.raises(FileNotFoundError):
        quantile.load(str(tmp_path))
    artifact = quantile.Artifact(models, {"columns": ["g"], "values": {"g": ["a", "b"]}}, {"rows": 600, "months": ["2024-01"]})
    quantile.save(artifact, str(tmp_path))
    loaded = quantile.load(str(tmp_path))
    assert np.array_equal(loaded.models[0.9].predict(frame), models[0.9].predict(frame))
    assert loaded.codes == artifact.codes and loaded.metadata == artifact.metadata
    (tmp_path / "model.json").write_text('{"format_version": 0, "models": []}')
    with pytest.raises(ValueError):
        quantile.load(str(tmp_path))
    (tmp_path / "model.json").write_text("[]")
    with pytest.raises(ValueError):
        quantile.load(str(tmp_path))


def test_codes_are_categories():
    """A target that depends on which code it is, not on how large, is found in one split; features never split on are listed."""
    rng = np.random.default_rng(1)
    code = rng.integers(-1, 12, 900)
    frame = pd.DataFrame({"feat_g_code": code, "feat_const": 1.0})
    high = np.isin(code, [-1, 2, 5, 6, 11])
    target = np.where(high, 100.0, 10.0) + rng.normal(size=900)
    model = quantile.QuantileGBM(0.5, ["feat_g_code", "feat_const"]).fit(frame, target)
    root = model.trees[0][0]
    assert set(root["codes"]) in ({-1, 2, 5, 6, 11}, set(range(-1, 12)) - {-1, 2, 5, 6, 11})
    assert np.abs(model.predict(frame) - target).mean() < 2
    assert quantile.importance({0.5: model}, 0.5)[-1] == ("feat_const", 0)
    unseen = model.predict(pd.DataFrame({"feat_g_code": [99.0, np.nan], "feat_const": 1.0}))
    assert np.isfinite(unseen).all()


def test_forecasts_do_not_cross(spark):
    rows = catalogue.QUERIES["quantile_gbm_forecast"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) and (rows["pred_q10"] <= rows["pred_q50"]).all() and (rows["pred_q50"] <= rows["pred_q90"]).all()
    assert np.isfinite(rows[["pred_q10", "pred_q90"]].to_numpy()).all()
