"""Gradient-boosted trees: fit with early stopping, seeded search, margins, and exact additive contributions.

Contributions are path-dependent Shapley values: along the path to a leaf, a feature that the row satisfies counts 1 and one that is
left out counts the share of training rows that go that way. For each leaf all subsets of its few features are summed through the
coefficients of a polynomial, vectorised over rows. They add up to the margin, which check_additivity holds the model to.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MODEL, ModelConfig
from ..operators.metrics import pr_auc
from ..schemas import CATEGORIES

MISSING = -1.0


def assembled(frame: DataFrame, names: list[str]) -> DataFrame:
    """The frame with `x`, the features in order; the category is nominal with its fixed levels and one for unknown ones."""
    levels = {"ml_attr": {"type": "nominal", "vals": [*CATEGORIES, "unknown"]}}
    code = F.coalesce(F.expr(" ".join(["CASE merchant_category", *[f"WHEN '{c}' THEN {k}" for k, c in enumerate(CATEGORIES)], "END"])), F.lit(len(CATEGORIES))).cast("double") if "merchant_category" in names else None
    columns = [code.alias("_x_merchant_category", metadata=levels) if n == "merchant_category" else F.coalesce(F.col(n).cast("double"), F.lit(MISSING)).alias(f"_x_{n}") for n in names]
    return VectorAssembler(inputCols=[f"_x_{n}" for n in names], outputCol="x").transform(frame.select("*", *columns)).drop(*[f"_x_{n}" for n in names])


def fit(train: DataFrame, early_stop: DataFrame, names: list[str], params: dict, label: str = "is_fraud", rounds: int = MODEL.rounds, seed: int = MODEL.seed) -> GBTClassificationModel:
    """Boosting until the early-stop rows no longer improve. No class is given more weight."""
    rows = train.withColumn("_valid", F.lit(False)).unionByName(early_stop.withColumn("_valid", F.lit(True)), allowMissingColumns=True).withColumn("_y", F.col(label).cast("double"))
    booster = GBTClassifier(
        featuresCol="x", labelCol="_y", validationIndicatorCol="_valid", validationTol=0.001, maxIter=rounds, seed=seed, maxBins=64,
        maxDepth=params.get("max_depth", 4), stepSize=params.get("learning_rate", 0.1), minInstancesPerNode=params.get("min_child_weight", 1),
        subsamplingRate=params.get("subsample", 1.0), featureSubsetStrategy=str(params.get("colsample_bytree", "all")),
    )
    return booster.fit(assembled(rows, names).select("x", "_y", "_valid"))


def predict(model: GBTClassificationModel, frame: DataFrame, names: list[str]) -> DataFrame:
    """The frame with margin (log-odds) and p_model."""
    out = model.transform(assembled(frame, names))
    return out.withColumns({"margin": 2.0 * vector_to_array("rawPrediction")[1], "p_model": vector_to_array("probability")[1]}).drop("x", "rawPrediction", "probability", "prediction")


def grid_draws(cfg: ModelConfig = MODEL) -> list[dict]:
    """Distinct seeded draws from the grid."""
    every = [dict(zip(cfg.grid, values, strict=True)) for values in itertools.product(*cfg.grid.values())]
    order = np.random.default_rng(cfg.seed).permutation(len(every))
    return [every[k] for k in order[: cfg.trials]]


def search(train: DataFrame, early_stop: DataFrame, valid: DataFrame, names: list[str], draws: list[dict], rounds: int = MODEL.rounds, label: str = "is_fraud") -> tuple[GBTClassificationModel, dict, list[tuple[dict, float, int]]]:
    """The draw with the best average precision on valid; of equal ones that with fewer trees."""
    tried = []
    for params in draws:
        model = fit(train, early_stop, names, params, label, rounds)
        quality = pr_auc(predict(model, valid, names), "p_model", label).first()["pr_auc"] or 0.0
        tried.append((model, params, quality, model.getNumTrees))
    best = min(tried, key=lambda t: (-t[2], t[3]))
    return best[0], best[1], [(p, q, n) for _, p, q, n in tried]


@dataclass
class Leaf:
    value: float
    #: Per feature on the path: place, kept share, and the conditions (low exclusive, high inclusive, or a set of categories).
    conditions: list[tuple[int, float, float, float, frozenset | None]]


def leaves(model: GBTClassificationModel) -> list[Leaf]:
    """All leaves of all trees, weighted so that contributions add up to the margin."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):

        def walk(node, path, weight=weight):
            if node.subtreeDepth() == 0:
                out.append(Leaf(2.0 * weight * node.prediction(), merged(path)))
                return
            split, k = node.split(), node.split().featureIndex()
            n = node.impurityStats().count()
            left, right = node.leftChild(), node.rightChild()
            for child, is_left in ((left, True), (right, False)):
                share = child.impurityStats().count() / n
                if split.getClass().getSimpleName() == "CategoricalSplit":
                    names = split.leftCategories() if is_left else split.rightCategories()
                    condition = (-np.inf, np.inf, frozenset(int(c) for c in names))
                else:
                    condition = (-np.inf, split.threshold(), None) if is_left else (split.threshold(), np.inf, None)
                walk(child, [*path, (k, share, *condition)])

        walk(tree._call_java("rootNode"), [])
    return out


def merged(path: list) -> list:
    """One condition per feature: shares multiply, ranges and sets intersect."""
    held: dict[int, list] = {}
    for k, share, low, high, names in path:
        if k in held:
            h = held[k]
            held[k] = [h[0] * share, max(h[1], low), min(h[2], high), names if h[3] is None else h[3] if names is None else h[3] & names]
        else:
            held[k] = [share, low, high, names]
    return [(k, *h) for k, h in held.items()]


def contributions(all_leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """A row per row of x: a value per feature, and the base in the last column."""
    n, d = x.shape
    out = np.zeros((n, d + 1))
    for leaf in all_leaves:
        m = len(leaf.conditions)
        zero = np.array([c[1] for c in leaf.conditions])
        out[:, d] += leaf.value * zero.prod()
        if not m:
            continue
        one = np.empty((n, m))
        for j, (k, _, low, high, names) in enumerate(leaf.conditions):
            one[:, j] = np.isin(x[:, k], [*names]) if names is not None else (x[:, k] > low) & (x[:, k] <= high)
        for i in range(m):
            poly = [np.ones(n)]
            for j in range(m):
                if j != i:
                    poly = [(poly[k] * zero[j] if k < len(poly) else 0) + (poly[k - 1] * one[:, j] if k else 0) for k in range(len(poly) + 1)]
            share = sum(c * factorial(k) * factorial(m - 1 - k) / factorial(m) for k, c in enumerate(poly))
            out[:, leaf.conditions[i][0]] += leaf.value * (one[:, i] - zero[i]) * share
    return out


def explain(model: GBTClassificationModel, frame: DataFrame, names: list[str], key: str = "txn_id") -> DataFrame:
    """key, contributions (name, value) in feature order, and base. The leaves are broadcast: a model's size, not the data's."""
    sent = frame.sparkSession.sparkContext.broadcast(leaves(model))

    def run(batches):
        for pdf in batches:
            values = contributions(sent.value, np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), len(names)))
            entries = [[{"name": f, "value": float(v)} for f, v in zip(names, row[:-1], strict=True)] for row in values]
            yield pd.DataFrame({key: pdf[key], "contributions": entries, "base": values[:, -1]})

    rows = assembled(frame, names).select(key, vector_to_array("x").alias("x"))
    return rows.mapInPandas(run, f"{key} {frame.schema[key].dataType.simpleString()}, contributions array<struct<name:string,value:double>>, base double")


def check_additivity(explained: DataFrame, predicted: DataFrame, key: str = "txn_id", tolerance: float = 1e-4) -> float:
    """The largest gap between summed contributions and margin; beyond the tolerance an error."""
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["value"])
    worst = explained.join(predicted.select(key, "margin"), key).agg(F.max(F.abs(total - F.col("margin")))).first()[0] or 0.0
    if worst > tolerance:
        raise AssertionError(f"contributions miss the margin by {worst:.2e}")
    return worst
