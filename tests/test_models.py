import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrisk.config import SplitConfig
from sparkrisk.models import forest, policy, reasons, trees
from sparkrisk.operators import metrics, predicates
from sparkrisk.schemas import FEATURES


def scored(spark, ys, scores):
    return spark.createDataFrame([(float(s), int(y), 10.0, "RING") for s, y in zip(scores, ys, strict=True)], "s double, y int, amount double, kind string")


def test_average_precision_and_auc(spark):
    rng = random.Random(3)
    ys, ss = [int(rng.random() < 0.3) for _ in range(300)], [round(rng.random(), 1) for _ in range(300)]
    pairs = [(a, b) for a, ya in zip(ss, ys, strict=True) if ya for b, yb in zip(ss, ys, strict=True) if not yb]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    ap = before = 0.0
    for t in sorted(set(ss), reverse=True):
        hit = [y for s, y in zip(ss, ys, strict=True) if s >= t]
        ap += sum(hit) / len(hit) * (sum(hit) / sum(ys) - before)
        before = sum(hit) / sum(ys)
    frame = scored(spark, ys, ss)
    assert metrics.roc_auc(frame, "s", "y").first()[0] == pytest.approx(auc)
    assert metrics.pr_auc(frame, "s", "y").first()[0] == pytest.approx(ap)
    assert metrics.pr_auc(frame.where("y = 1"), "s", "y").first()[0] is None


def test_thresholds(spark):
    frame = scored(spark, [1, 1, 0, 1, 0, 0, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0])
    assert metrics.operating_point(frame, "s", "y", 0.2).first()["threshold"] == 0.8
    assert metrics.operating_point(frame, "s", "y", 1.0).first()["threshold"] == 0.6
    assert metrics.operating_point(frame, "s", "y", 0.2, most=512).first()["threshold"] == 0.8
    assert metrics.operating_point(frame, "s", "y", 0.0).first() is None
    assert metrics.hold_threshold(frame, "s", "y", 1.0, 2).first()["threshold"] == 0.8
    assert metrics.hold_threshold(frame, "s", "y", 1.0, 3).first() is None
    e = metrics.evaluate_at(frame, "s", "y", 0.7, "amount", 0.85).first()
    assert (e["alerts"], e["caught"], round(e["recall"], 4), e["holds"]) == (3, 2, 0.6667, 1)


def test_degenerate_hold(spark):
    from sparkrisk.config import DecisionConfig

    frame = scored(spark, [1, 1, 1, 0], [0.9, 0.8, 0.7, 0.1])
    t = policy.choose(frame, "s", "y", DecisionConfig(review_budget=1.0, hold_precision=0.9, hold_alerts=1))
    assert t.review == 0.7 and t.hold is None and t.note


def test_guard(monkeypatch):
    monkeypatch.delenv("ALLOW_TEST", raising=False)
    with pytest.raises(PermissionError):
        predicates.guard("test", SplitConfig())
    monkeypatch.setenv("ALLOW_TEST", "1")
    predicates.guard("test", SplitConfig())


NAMES = ["a", "b", "merchant_category"]


@pytest.fixture(scope="module")
def table(spark):
    base = spark.range(400).select(F.col("id").alias("txn_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.when(F.rand(3) < 0.5, "fuel").otherwise("travel").alias("merchant_category"))
    return base.withColumn("is_fraud", ((F.col("a") > 0.7) & ((F.col("b") > 0.4) | (F.col("merchant_category") == "fuel"))).cast("int")).cache()


@pytest.fixture(scope="module")
def booster(table):
    return trees.fit(table.where("txn_id % 4 <> 0"), table.where("txn_id % 4 = 0"), NAMES, {"max_depth": 3, "learning_rate": 0.3}, rounds=6)


def test_contributions_add_up(table, booster):
    predicted = trees.predict(booster, table, NAMES)
    assert trees.check_additivity(trees.explain(booster, table, NAMES), predicted) < 1e-6
    assert metrics.pr_auc(predicted, "p_model", "is_fraud").first()[0] > 0.9


def test_contributions_are_shapley_values(booster, table):
    """Against the definition, with all subsets of the three features, on one leaf set."""
    from itertools import combinations
    from math import factorial

    from pyspark.ml.functions import vector_to_array

    all_leaves = trees.leaves(booster)
    x = np.array([r[0] for r in trees.assembled(table.limit(5), NAMES).select(vector_to_array("x")).collect()])

    def value(row, known):
        total = 0.0
        for leaf in all_leaves:
            p = leaf.value
            for k, share, low, high, names in leaf.conditions:
                ok = row[k] in names if names is not None else low < row[k] <= high
                p *= (1.0 if ok else 0.0) if k in known else share
            total += p
        return total

    got = trees.contributions(all_leaves, x)
    for r, row in enumerate(x):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = sum(factorial(n) * factorial(2 - n) / 6 * (value(row, {*s, i}) - value(row, set(s))) for n in range(3) for s in combinations(others, n))
            assert got[r, i] == pytest.approx(want, abs=1e-9)


def test_search_and_draws(table):
    draws = trees.grid_draws()
    assert len(draws) == 20 and len({str(d) for d in draws}) == 20 and draws == trees.grid_draws()
    model, params, tried = trees.search(table.where("txn_id % 4 = 1"), table.where("txn_id % 4 = 2"), table.where("txn_id % 4 = 3"), NAMES, [{"max_depth": 1}, {"max_depth": 3}], rounds=3)
    assert len(tried) == 2 and params in [{"max_depth": 1}, {"max_depth": 3}]


def test_forest(spark):
    from dataclasses import replace

    from sparkrisk.config import MODEL

    cfg = replace(MODEL, forest_trees=30, forest_sample=128, quantile_points=101)
    rows = spark.range(500).select(F.col("id").alias("txn_id"), F.randn(1).alias("a"), F.randn(2).alias("b"))
    f = forest.fit(rows, ["a", "b"], cfg=cfg)
    odd = spark.createDataFrame([(-1, 9.0, -9.0), (-2, 0.0, 0.0)], rows.schema)
    got = {r["txn_id"]: r for r in forest.score(f, odd).collect()}
    assert got[-1]["anomaly_pct"] >= 0.99 > got[-2]["anomaly_pct"] and sorted(got[-1]["strangest"]) == ["a", "b"]
    assert 0.4 < forest.score(f, rows).agg(F.avg("anomaly_pct")).first()[0] < 0.6


def test_reasons(spark):
    values = {f: 0.0 for f in FEATURES} | {"merchant_category": "fuel", "log_amount": float(np.log1p(1_234.0)), "acct_cnt_5m": 7.0}
    base = spark.createDataFrame([values]).withColumns({"anomaly_pct": F.lit(0.995), "strangest": F.array(F.lit("log_amount"), F.lit("is_night"))})
    entries = [F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in [("log_amount", 0.5), ("acct_cnt_5m", 0.9), ("is_night", -1.0)]]
    import json

    got = json.loads(reasons.with_reasons(base.withColumn("contributions", F.array(*entries))).first()["reasons"])
    assert [r["text"] for r in got] == ["7 payments in the previous 5 minutes", "Payment of ₹1,234", "Unusual combination: payment amount and overnight payment far outside typical values"]


def test_save_and_load(spark, table, booster, tmp_path):
    from dataclasses import replace

    from sparkrisk.config import MODEL

    f = forest.fit(table, ["a", "b"], cfg=replace(MODEL, forest_trees=10, forest_sample=64, quantile_points=11))
    model = policy.RiskModel(booster, f, NAMES, 0.8, policy.Thresholds(0.5, 0.9))
    policy.save(model, str(tmp_path / "m"), table.limit(50))
    again = policy.load(spark, str(tmp_path / "m"))
    assert again.thresholds == model.thresholds and again.names == NAMES
    again.spec = "fs0"
    with pytest.raises(ValueError):
        policy.score(again, table)
