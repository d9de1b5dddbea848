"""Metrics of scores against labels, from one cumulative table per distinct score.

The table has a row per distinct score, so it is far smaller than the events; running sums over it are taken per range of scores
first and offset by the ranges' totals, so that no task sees the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DECISIONS
from ..functions.scalar import ratio
from .aggregates import count_if
from .ranged import offsets, range_of


def cumulative(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: rows and hits at it, and alerts and caught at or above it."""
    at = scored.select(F.col(score).cast("double").alias("score"), F.col(label).cast("long").alias("y")).where("score is not null")
    rows = at.groupBy("score").agg(F.count("*").alias("rows"), F.sum("y").alias("hits"))
    ranged = rows.withColumn("part", range_of(rows, "score"))
    before = offsets(ranged, "part", {"r": F.sum("rows"), "h": F.sum("hits")}, descending=True)
    down = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.select("part", "score", "rows", "hits", F.sum("rows").over(down).alias("a"), F.sum("hits").over(down).alias("c"))
    return sums.join(F.broadcast(before), "part").select("score", "rows", "hits", (F.col("a") + F.col("r")).alias("alerts"), (F.col("c") + F.col("h")).alias("caught"))


def totals(scored: DataFrame, score: str, label: str) -> tuple[int, int]:
    row = scored.where(F.col(score).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("p")).first()
    return row["n"], row["p"]


def pr_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision: the sum over distinct scores of precision times the step in recall. Null if a class is missing."""
    n, p = totals(scored, score, label)
    value = F.sum(F.col("caught") / F.col("alerts") * F.col("hits") / float(p or 1))
    return cumulative(scored, score, label).agg((value if 0 < p < n else F.lit(None).cast("double")).alias("pr_auc"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties counted half. Null if a class is missing."""
    n, p = totals(scored, score, label)
    misses = F.col("rows") - F.col("hits")
    below = float(n - p) - (F.col("alerts") - F.col("caught"))
    value = F.sum(F.col("hits") * (below + misses / 2.0)) / float(max(1, p) * max(1, n - p))
    return cumulative(scored, score, label).agg((value if 0 < p < n else F.lit(None).cast("double")).alias("roc_auc"))


def points(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Precision, recall, F1 and alert rate of each distinct score as threshold."""
    n, p = totals(scored, score, label)
    precision, recall = F.col("caught") / F.col("alerts"), F.col("caught") / float(p) if p else F.lit(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return cumulative(scored, score, label).select(F.col("score").alias("threshold"), "alerts", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), (F.col("alerts") / float(max(1, n))).alias("alert_rate"))


def candidate_thresholds(scored: DataFrame, score: str, most: int = DECISIONS.candidates) -> DataFrame:
    """The distinct scores, or so many quantiles of them where there are more."""
    distinct = scored.select(F.col(score).cast("double").alias("threshold")).distinct()
    if distinct.count() <= most:
        return distinct
    return distinct.agg(F.percentile("threshold", [k / (most - 1) for k in range(most)]).alias("t")).select(F.explode("t").alias("threshold")).distinct()


def operating_point(scored: DataFrame, score: str, label: str, budget: float = DECISIONS.review_budget, most: int | None = None) -> DataFrame:
    """The threshold with the best F1 among those that alert on no more than the budget; of equal ones the highest. most: consider
    that many candidate thresholds only (quantiles of the distinct scores), else all. No row if none qualifies with an F1 above 0."""
    table = points(scored, score, label)
    if most is not None:
        # a candidate acts like the lowest score at or above it; of candidates that act alike the highest is named
        names = sorted(r["threshold"] for r in candidate_thresholds(scored, score, most).collect())  # at most `most` numbers
        marks = F.array(*[F.lit(x) for x in names])
        passed = table.withColumn("passed", F.size(F.filter(marks, lambda x: x <= F.col("threshold")))).where("passed > 0")
        lowest = passed.groupBy("passed").agg(F.min_by(F.struct(*table.columns), "threshold").alias("at"))
        table = lowest.select(F.element_at(marks, F.col("passed")).alias("threshold"), *[f"at.{c}" for c in table.columns if c != "threshold"])
    fit = table.where((F.col("alert_rate") <= budget) & (F.col("f1") > 0))
    return fit.orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def hold_threshold(scored: DataFrame, score: str, label: str, precision: float = DECISIONS.hold_precision, alerts: int = DECISIONS.hold_alerts) -> DataFrame:
    """The lowest threshold with that precision on that many alerts; no row if there is none."""
    fit = points(scored, score, label).where((F.col("precision") >= precision) & (F.col("alerts") >= alerts))
    return fit.orderBy("threshold").limit(1)


def evaluate_at(scored: DataFrame, score: str, label: str, threshold: float, amount: str | None = None, hold_at: float | None = None) -> DataFrame:
    """One row: counts, precision, recall, F1, false positive rate, alert rate, share of fraud value detected, and the hold block."""
    flagged, fraud = F.col(score) >= threshold, F.col(label) == 1
    value = F.col(amount) if amount else F.lit(0.0)
    held = F.col(score) >= hold_at if hold_at is not None else F.lit(False)
    out = scored.agg(
        F.count("*").alias("n"), count_if(fraud).alias("fraud"), count_if(flagged).alias("alerts"), count_if(flagged & fraud).alias("caught"),
        F.coalesce(F.sum(F.when(fraud, value)), F.lit(0.0)).alias("_v"), F.coalesce(F.sum(F.when(fraud & flagged, value)), F.lit(0.0)).alias("_d"), count_if(held).alias("holds"), count_if(held & fraud).alias("hold_caught"),
    )
    out = out.withColumns({"precision": ratio("caught", "alerts"), "recall": ratio("caught", "fraud"), "fpr": ratio(F.col("alerts") - F.col("caught"), F.col("n") - F.col("fraud")), "alert_rate": ratio("alerts", "n"), "value_detected": ratio("_d", "_v"), "hold_precision": ratio("hold_caught", "holds")})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("_v", "_d")


def recall_by(scored: DataFrame, score: str, label: str, threshold: float, kind: str) -> DataFrame:
    """Recall of each kind of fraud."""
    out = scored.where(F.col(label) == 1).groupBy(kind).agg(F.count("*").alias("fraud"), count_if(F.col(score) >= threshold).alias("caught"))
    return out.withColumn("recall", ratio("caught", "fraud"))


def best_weight(runs: DataFrame) -> DataFrame:
    """(weight, mean recall) of the weight with the best mean recall over the withheld patterns; of equal ones the largest."""
    return runs.groupBy("weight").agg(F.avg("recall").alias("mean_recall")).orderBy(F.desc("mean_recall"), F.desc("weight")).limit(1)
