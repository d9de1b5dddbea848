"""Queries over models; those whose fits no SQL can express are held against independent code in the tests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import MODEL
from ..models import forest, policy, reasons, trees
from ..operators import metrics
from ..schemas import HOT_FEATURES
from ..sources import driver as D
from .features import DRIVER_SPLITS, hot
from .registry import query

NAMES = [f for f in HOT_FEATURES if f != "merchant_category"]
SMALL = replace(MODEL, forest_trees=40, forest_sample=256, quantile_points=101)
#: With these the driver's few frauds are learned in seconds; the operators' own defaults are those of the configuration.
PARAMS, ROUNDS = {"max_depth": 3, "learning_rate": 0.2}, 8


def splits(spark, sf_dir):
    from ..operators.predicates import select_split, tag_splits
    from ..operators.tables import kept

    table = kept(tag_splits(hot(spark, sf_dir).join(D.labels(spark, sf_dir), "txn_id"), cfg=DRIVER_SPLITS))
    return [select_split(table, s, DRIVER_SPLITS) for s in ("train", "early_stop", "valid")]


@query()
def boosted_scores(spark, sf_dir):
    """Margin and probability of the valid rows from boosted trees."""
    train, early_stop, valid = splits(spark, sf_dir)
    model = trees.fit(train, early_stop, HOT_FEATURES, PARAMS, rounds=ROUNDS)
    return trees.predict(model, valid, HOT_FEATURES).select("txn_id", "is_fraud", "margin", "p_model")


@query()
def boosted_contributions(spark, sf_dir):
    """What each feature adds to the margin of the valid rows."""
    train, early_stop, valid = splits(spark, sf_dir)
    model = trees.fit(train, early_stop, HOT_FEATURES, PARAMS, rounds=ROUNDS)
    return trees.explain(model, valid, HOT_FEATURES).select("txn_id", "base", F.explode("contributions").alias("c")).select("txn_id", "base", "c.name", "c.value")


@query()
def anomaly_scores(spark, sf_dir):
    """Isolation forest of the training rows over the valid rows."""
    train, _, valid = splits(spark, sf_dir)
    return forest.score(forest.fit(train, NAMES, cfg=SMALL), valid)


@query()
def risk_scores(spark, sf_dir):
    """Model and anomaly blended, with decisions and the alerts' reasons."""
    from ..config import GRAPH

    train, early_stop, valid = splits(spark, sf_dir)
    model = policy.RiskModel(trees.fit(train, early_stop, HOT_FEATURES, PARAMS, rounds=ROUNDS), forest.fit(train, NAMES, cfg=SMALL), HOT_FEATURES, 0.8, policy.Thresholds(None, None))
    model.thresholds = policy.choose(policy.score(model, valid, explain=False), "risk", "is_fraud")
    warm = valid.withColumns({n: F.lit(v) for n, v in GRAPH.defaults})
    return policy.score(model, warm).select("txn_id", "p_model", "anomaly_pct", "risk", "decision", "reasons")


@query(D.with_ctes("SELECT weight, round(mean_recall, 8) AS mean_recall FROM (SELECT weight, AVG(recall) AS mean_recall FROM (SELECT (txn_id % 5) / 10.0 + 0.5 AS weight, (txn_id % 40) / 40.0 AS recall FROM e) AS r GROUP BY weight) AS m ORDER BY mean_recall DESC, weight DESC LIMIT 1"))
def best_blend_weight(spark, sf_dir):
    runs = D.events(spark, sf_dir).select((F.col("txn_id") % 5 / 10.0 + 0.5).alias("weight"), (F.col("txn_id") % 40 / 40.0).alias("recall"))
    return metrics.best_weight(runs).withColumn("mean_recall", F.round("mean_recall", 8))


@query(D.with_ctes("SELECT txn_id, CAST(CAST(round_even(lat, 0) AS BIGINT) AS VARCHAR) || ' payments in the previous hour' AS text, CASE WHEN amount >= lon AND amount >= 50 THEN 'a' WHEN lon > 50 THEN 'b' ELSE 'a' END AS best FROM e"))
def rendered_reasons(spark, sf_dir):
    """A reason's text, and the larger of two contributions."""
    e = D.events(spark, sf_dir)
    pair = F.array(F.struct(F.lit("a").alias("name"), (F.col("amount") - 0.0).alias("value")), F.struct(F.lit("b").alias("name"), F.greatest(F.col("lon"), F.lit(50.0)).alias("value")))
    return e.withColumn("contributions", pair).select("txn_id", reasons.sentence("acct_cnt_1h", F.col("lat")).alias("text"), reasons.top(k=1)[0]["name"].alias("best"))
