"""Quantile regression by boosted histogram trees, one model a fold and quantile.

Trees are grown on the pinball gradient and their leaves set to the quantile of the residuals. Codes of
categories are split into sets, whatever their order: categories are put in order of their mean gradient
and cut there. Rows and columns are drawn for every tree from a fixed seed; the queries sort a model's rows first, so results repeat.
Models are fitted in parallel, one Arrow group each; a group is one fold of the panel, which has a row a
department and business day.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .landing import QUANTILES, feature_columns, training_target

FORMAT_VERSION = 2
#: The reference's hyper-parameters; BINS is our own.
ROUNDS, RATE, LEAVES, MIN_LEAF, ROW_SHARE, COLUMN_SHARE, SEED, BINS = 300, 0.05, 15, 30, 0.9, 0.8, 42, 32


@dataclass
class QuantileGBM:
    quantile: float
    features: list[str]
    start: float = 0.0
    trees: list[list[dict]] = field(default_factory=list)
    splits: dict[str, int] = field(default_factory=dict)

    @property
    def categories(self) -> frozenset[int]:
        """Features that hold codes of categories."""
        return frozenset(j for j, name in enumerate(self.features) if is_code(name))

    def _matrix(self, frame: pd.DataFrame) -> np.ndarray:
        missing = [c for c in self.features if c not in frame]
        if missing:
            raise KeyError(f"missing features: {', '.join(missing)}")
        return frame[self.features].to_numpy(np.float64)

    def fit(self, frame: pd.DataFrame, target: np.ndarray) -> QuantileGBM:
        x = self._matrix(frame)
        x = np.array(x)
        for j in self.categories:
            x[:, j] = np.nan_to_num(x[:, j], nan=-1)
        edges = [
            np.arange(max(c.max(initial=-1), -1) + 1) if j in self.categories else np.unique(np.nanquantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if np.isfinite(c).any() else np.zeros(0)
            for j, c in enumerate(x.T)
        ]
        binned = np.stack([np.where(np.isnan(c), 0, np.searchsorted(e, c, side="right") + 1) for c, e in zip(x.T, edges)], axis=1)
        self.start = float(np.quantile(target, self.quantile))
        guess = np.full(len(target), self.start)
        draw = np.random.default_rng(SEED)
        for _ in range(ROUNDS):
            residual = target - guess
            rows = np.sort(draw.choice(len(target), max(1, int(len(target) * ROW_SHARE)), replace=False))
            columns = np.sort(draw.choice(len(edges), max(1, round(len(edges) * COLUMN_SHARE)), replace=False))
            tree, leaf = self._tree(binned, np.where(residual > 0, self.quantile, self.quantile - 1.0), edges, rows, columns)
            for node, held in leaf.items():
                tree[node]["value"] = RATE * float(np.quantile(residual[held], self.quantile))
            guess += self._values(tree, x)
            self.trees.append(tree)
        return self

    def _tree(self, binned: np.ndarray, gradient: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> tuple[list[dict], dict[int, np.ndarray]]:
        """A tree of LEAVES leaves at most, grown where a split gains most."""
        nodes: list[dict] = [{}]
        leaves: dict[int, np.ndarray] = {0: rows}
        found = {0: self._split(binned[rows], gradient[rows], edges, columns)}
        while len(leaves) < LEAVES and any(found.values()):
            node = max((n for n in found if found[n]), key=lambda n: (found[n][2], -n))
            feature, cut, _ = found.pop(node)
            rows = leaves.pop(node)
            if feature in self.categories:
                left = np.isin(binned[rows, feature], cut)
                nodes[node] |= {"feature": feature, "codes": [int(c) - 2 for c in cut]}
            else:
                left = binned[rows, feature] <= cut
                nodes[node] |= {"feature": feature, "cut": None if cut == 0 else float(edges[feature][cut - 1])}
            nodes[node] |= {"left": len(nodes), "right": len(nodes) + 1}
            self.splits[self.features[feature]] = self.splits.get(self.features[feature], 0) + 1
            for part in (rows[left], rows[~left]):
                leaves[len(nodes)] = part
                found[len(nodes)] = self._split(binned[part], gradient[part], edges, columns) if len(part) >= 2 * MIN_LEAF else None
                nodes.append({})
        return nodes, leaves

    def _split(self, binned: np.ndarray, gradient: np.ndarray, edges: list[np.ndarray], columns: np.ndarray) -> tuple[int, int | np.ndarray, float] | None:
        """Feature, bin (or set of a category's bins) that goes left, and gain of the best split."""
        total, n = gradient.sum(), len(gradient)
        best, gain = None, 1e-9
        for j in map(int, columns):
            size = len(edges[j]) + 2
            sums, counts = np.bincount(binned[:, j], gradient, size), np.bincount(binned[:, j], minlength=size)
            order = np.arange(size)
            if j in self.categories:
                order = np.flatnonzero(counts)
                order = order[np.argsort(sums[order] / counts[order], kind="stable")]
            g, c = np.cumsum(sums[order])[:-1], np.cumsum(counts[order])[:-1]
            fine = (c >= MIN_LEAF) & (n - c >= MIN_LEAF)
            if fine.any():
                score = np.where(fine, g**2 / np.maximum(c, 1) + (total - g) ** 2 / np.maximum(n - c, 1) - total**2 / n, 0.0)
                if score.max() > gain:
                    gain = float(score.max())
                    at = int(score.argmax())
                    best = (j, order[: at + 1] if j in self.categories else at, gain)
        return best

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        if not self.trees:
            raise RuntimeError("the model is not fitted")
        x = self._matrix(frame)
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self._values(tree, x)
        return out

    @staticmethod
    def _values(tree: list[dict], x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for node, split in enumerate(tree):  # children come after their parents
            if "feature" in split and len(rows := np.flatnonzero(at == node)):
                value, cut = x[rows, split["feature"]], split.get("cut")
                if "codes" in split:
                    left = np.isin(np.nan_to_num(value, nan=-1), split["codes"])
                else:
                    left = np.isnan(value) if cut is None else np.isnan(value) | (value < cut)
                at[rows] = np.where(left, split["left"], split["right"])
        return np.array([t.get("value", 0.0) for t in tree])[at]


def is_code(name: str) -> bool:
    """Whether a feature holds codes of categories."""
    return name.startswith("feat_") and name.endswith("_code")


def importance(models: dict[float, QuantileGBM], quantile: float) -> list[tuple[str, int]]:
    """Split counts of all features, most first; KeyError for a quantile without a model."""
    if quantile not in models:
        raise KeyError(f"no model of quantile {quantile}, only of {sorted(models)}")
    model = models[quantile]
    return sorted(((f, model.splits.get(f, 0)) for f in model.features), key=lambda x: (-x[1], x[0]))


@dataclass
class Artifact:
    """What a forecast needs later on: the models, the codes of categories (as plain data) and what there is to know of their training."""

    models: dict[float, QuantileGBM]
    codes: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


def save(artifact: Artifact, folder: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    data = {"format_version": FORMAT_VERSION, "models": [vars(m) for m in artifact.models.values()], "codes": artifact.codes, "metadata": artifact.metadata}
    Path(folder, "model.json").write_text(json.dumps(data, ensure_ascii=False, default=str))


def load(folder: str) -> Artifact:
    """FileNotFoundError without a file, ValueError for one that holds something else or has another format."""
    file = Path(folder, "model.json")
    if not file.exists():
        raise FileNotFoundError(f"{file} does not exist; train a model first")
    data = json.loads(file.read_text())
    if not isinstance(data, dict) or "models" not in data:
        raise ValueError(f"{file} holds no model")
    if data.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"format {data.get('format_version')}, expected {FORMAT_VERSION}; train the model again")
    return Artifact({m["quantile"]: QuantileGBM(**m) for m in data["models"]}, data["codes"], data["metadata"])


def _prepared(folded: DataFrame) -> tuple[DataFrame, list[str]]:
    features = feature_columns(folded)
    return folded.select("fold", "role", "department", "month", "landing", "cum_amount", "prev_year", training_target().alias("target"), *[F.col(c).cast("double").alias(c) for c in features]), features


def forecasts(folded: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """fold, department, month, step, landing and pred_q<q> for validation rows: at least zero to come, never crossing."""
    rows, features = _prepared(folded)
    each = rows.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles])))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["department", "month", "step"])
        train, val = group[group["role"] == "train"], group[group["role"] == "val"]
        model = QuantileGBM(float(group["q"].iloc[0]), features).fit(train, train["target"].to_numpy())
        return val[["fold", "department", "month", "step", "landing", "cum_amount", "prev_year", "q"]].assign(value=model.predict(val))

    schema = "fold int, department string, month date, step double, landing bigint, cum_amount bigint, prev_year bigint, q double, value double"
    long = each.groupBy("fold", "q").applyInPandas(fitted, schema)
    wide = long.groupBy("fold", "department", "month", "step", "landing", "cum_amount", "prev_year").agg(F.array_sort(F.collect_list(F.greatest("value", F.lit(0.0)))).alias("v"))
    return wide.select("fold", "department", "month", F.col("step").cast("int").alias("step"), "landing", *[(F.col("cum_amount") + F.col("v")[i] * F.col("prev_year")).alias(f"pred_q{round(q * 100)}") for i, q in enumerate(sorted(quantiles))])


def feature_importance(folded: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """fold, q, feature, splits."""
    rows, features = _prepared(folded.filter("role = 'train'"))
    each = rows.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles])))

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["department", "month", "step"])
        q = float(group["q"].iloc[0])
        model = QuantileGBM(q, features).fit(group, group["target"].to_numpy())
        return pd.DataFrame([(int(group["fold"].iloc[0]), q, name, n) for name, n in importance({q: model}, q)], columns=["fold", "q", "feature", "splits"])

    return each.groupBy("fold", "q").applyInPandas(counted, "fold int, q double, feature string, splits bigint")
