"""Isolation forest, fitted without labels on a seeded sample; scores are percentiles among the training rows' scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MODEL, ModelConfig
from ..operators.aggregates import quantile_table, spreads
from ..operators.predicates import sampled


def path_norm(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    feature: np.ndarray  # -1 in leaves
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray  # in leaves: depth and the mean depth of what was not split further


@dataclass
class Forest:
    names: list[str]
    trees: list[Tree]
    norm: float
    quantiles: list[float]
    medians: list[float]
    spreads: list[float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """2 ^ -(mean depth / norm): higher is stranger."""
        total, at = np.zeros(len(x)), np.arange(len(x))
        for t in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := t.feature[node] >= 0).any():
                go = x[at, np.maximum(t.feature[node], 0)] < t.split[node]
                node = np.where(inner, np.where(go, t.left[node], t.right[node]), node)
            total += t.depth[node]
        return 2.0 ** (-total / len(self.trees) / max(self.norm, 1e-9))

    def percentile(self, raw: np.ndarray) -> np.ndarray:
        points, first = np.unique(self.quantiles, return_index=True)
        return np.interp(raw, points, first / (len(self.quantiles) - 1), left=0.0, right=1.0)

    def strangest(self, x: np.ndarray, k: int = 2) -> list[list[str]]:
        """The k features furthest from the training medians, in spreads."""
        far = np.abs(x - np.array(self.medians)) / np.array(self.spreads)
        return [[self.names[j] for j in row] for row in np.argsort(-far, axis=1, kind="stable")[:, :k]]


def grow(x: np.ndarray, rng: np.random.Generator, most_depth: int) -> Tree:
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        place = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + float(path_norm(len(rows)))])
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_to = np.flatnonzero(high > low)
        if depth < most_depth and len(rows) > 1 and len(open_to):
            k = int(rng.choice(open_to))
            cut = float(rng.uniform(low[k], high[k]))
            go = rows[:, k] < cut
            if go.any() and not go.all():
                nodes[place][:2] = [k, cut]
                nodes[place][2] = add(rows[go], depth + 1)
                nodes[place][3] = add(rows[~go], depth + 1)
        return place

    add(x, 0)
    return Tree(*[np.array(c) for c in zip(*nodes, strict=True)])


def fit(train: DataFrame, names: list[str], key: str = "txn_id", cfg: ModelConfig = MODEL) -> Forest:
    """Trees on seeded samples (at most trees * sample rows reach the driver); quantiles, medians and spreads over all rows."""
    rows = sampled(train.select(key, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]), key, cfg.forest_trees * cfg.forest_sample, cfg.seed)
    pool = rows.select(*names).toPandas().to_numpy(dtype=float)
    rng = np.random.default_rng(cfg.seed)
    size = min(cfg.forest_sample, len(pool))
    depth = int(np.ceil(np.log2(max(size, 2))))
    trees = [grow(pool[rng.choice(len(pool), size, replace=False)], rng, depth) for _ in range(cfg.forest_trees)]
    facts = {r["feature"]: r for r in spreads(train, names).collect()}  # a row per feature
    forest = Forest(list(names), trees, float(path_norm(size)), [], [facts[n]["median"] for n in names], [facts[n]["spread"] for n in names])
    forest.quantiles = quantile_table(score(forest, train, key).select("raw"), "raw", cfg.quantile_points)
    return forest


def score(forest: Forest, frame: DataFrame, key: str = "txn_id") -> DataFrame:
    """key, raw, anomaly_pct (0 before the quantiles are known) and strangest."""
    names, sent = forest.names, frame.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for pdf in batches:
            own, x = sent.value, pdf[names].to_numpy(dtype=float)
            raw = own.raw(x)
            yield pd.DataFrame({key: pdf[key], "raw": raw, "anomaly_pct": own.percentile(raw) if own.quantiles else 0.0, "strangest": own.strangest(x)})

    rows = frame.select(key, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return rows.mapInPandas(run, f"{key} {frame.schema[key].dataType.simpleString()}, raw double, anomaly_pct double, strangest array<string>")
