"""Thresholds, the blend of model and anomaly, scoring, artifacts and experiments."""

from __future__ import annotations

import json
import pickle
import time
from dataclasses import asdict, dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DECISIONS, MODEL, DecisionConfig, ModelConfig
from ..functions.scalar import blend
from ..operators import metrics
from ..operators.predicates import apply_rules, decide, guard, is_alert
from ..schemas import FEATURE_SPEC_VERSION, FEATURES, HOT_FEATURES, NUMERIC_FEATURES, WARM_FEATURES
from . import forest as forests
from . import reasons, trees


@dataclass
class Thresholds:
    review: float | None
    hold: float | None
    note: str = ""


def choose(scored: DataFrame, score: str, label: str, cfg: DecisionConfig = DECISIONS) -> Thresholds:
    """REVIEW at the best F1 within the budget; HOLD at the lowest score of the wanted precision, unless it is not above REVIEW."""
    point = metrics.operating_point(scored, score, label, cfg.review_budget, cfg.candidates).first()
    hold = metrics.hold_threshold(scored, score, label, cfg.hold_precision, cfg.hold_alerts).first()
    review = point["threshold"] if point else None
    if hold is None:
        return Thresholds(review, None, "no threshold has the precision on enough alerts")
    if review is not None and hold["threshold"] <= review:
        return Thresholds(review, None, "hold would begin at or below review")
    return Thresholds(review, hold["threshold"])


@dataclass
class RiskModel:
    booster: GBTClassificationModel
    forest: forests.Forest
    names: list[str]
    weight: float
    thresholds: Thresholds
    version: str = "v1"
    spec: str = FEATURE_SPEC_VERSION


def score(model: RiskModel, frame: DataFrame, explain: bool = True, key: str = "txn_id") -> DataFrame:
    """p_model, anomaly_pct, risk and decision of each row, and reasons of the alerts. Only alerts are explained."""
    if model.spec != FEATURE_SPEC_VERSION:
        raise ValueError(f"the model was made for features {model.spec}, not {FEATURE_SPEC_VERSION}")
    predicted = trees.predict(model.booster, frame, model.names).join(forests.score(model.forest, frame, key), key)
    out = predicted.withColumn("risk", blend("p_model", "anomaly_pct", model.weight)).withColumn("decision", decide("risk", model.thresholds.review, model.thresholds.hold))
    out = out.withColumns({"model_version": F.lit(model.version), "feature_spec_version": F.lit(model.spec)})
    if not explain:
        return out
    alerts = out.where(is_alert())
    told = reasons.with_reasons(alerts.join(trees.explain(model.booster, alerts, model.names, key), key)).select(key, "reasons")
    return out.join(told, key, "left")


def withheld(frame: DataFrame, pattern: str) -> DataFrame:
    return frame.where(F.col("fraud_type") != pattern)


def leave_one_out(train: DataFrame, early_stop: DataFrame, valid: DataFrame, names: list[str], params: dict, forest: forests.Forest, cfg: ModelConfig = MODEL, rounds: int = MODEL.rounds) -> tuple[float, DataFrame, list[dict]]:
    """The blend weight by mean recall over refits that each withhold one pattern, the runs, and recall on the withheld pattern."""
    rows, evidence = [], []
    for pattern in cfg.patterns:
        model = trees.fit(withheld(train, pattern), withheld(early_stop, pattern), names, params, rounds=rounds)
        scored = trees.predict(model, valid, names).join(forests.score(forest, valid), "txn_id").select("txn_id", "is_fraud", "fraud_type", "p_model", "anomaly_pct")
        for w in cfg.blend_weights:
            blended = scored.withColumn("risk", blend("p_model", "anomaly_pct", w))
            point = metrics.operating_point(blended, "risk", "is_fraud").first()
            at = point["threshold"] if point else float("inf")
            rows.append((pattern, w, float(point["recall"]) if point else 0.0))
            kind = metrics.recall_by(blended, "risk", "is_fraud", at, "fraud_type").where(F.col("fraud_type") == pattern).first()
            evidence.append({"pattern": pattern, "weight": w, "threshold": at, "recall_withheld": kind["recall"] if kind else 0.0})
    runs = train.sparkSession.createDataFrame(rows, "pattern string, weight double, recall double")
    return metrics.best_weight(runs).first()["weight"], runs, evidence


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\u0001")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"].rstrip("\u0001")


def save(model: RiskModel, path: str, sample: DataFrame | None = None, tolerance: float = 1e-9) -> None:
    """A folder with booster, forest and metadata; with a sample, it is read again and must give the same risk."""
    spark = SparkSession.active()
    model.booster.write().overwrite().save(f"{path}/booster")
    write_text(spark, f"{path}/forest", pickle.dumps(model.forest).hex())
    import pyspark

    facts = {"names": model.names, "weight": model.weight, "thresholds": asdict(model.thresholds), "version": model.version, "spec": model.spec, "pyspark": pyspark.__version__, "saved": int(time.time())}
    write_text(spark, f"{path}/metadata", json.dumps(facts, sort_keys=True))
    if sample is not None:
        again = score(load(spark, path), sample, explain=False).select("txn_id", F.col("risk").alias("again"))
        gap = score(model, sample, explain=False).select("txn_id", "risk").join(again, "txn_id").agg(F.max(F.abs(F.col("risk") - F.col("again")))).first()[0]
        if gap is not None and gap > tolerance:
            raise AssertionError(f"the saved model scores differently by {gap:.2e}")


def load(spark: SparkSession, path: str) -> RiskModel:
    """The saved model, once its feature spec and its minor version of the library fit."""
    import pyspark

    facts = json.loads(read_text(spark, f"{path}/metadata"))
    if facts["spec"] != FEATURE_SPEC_VERSION:
        raise ValueError(f"the model was made for features {facts['spec']}, not {FEATURE_SPEC_VERSION}")
    if facts["pyspark"].split(".")[:2] != pyspark.__version__.split(".")[:2]:
        raise ValueError(f"the model was made with {facts['pyspark']}")
    forest = pickle.loads(bytes.fromhex(read_text(spark, f"{path}/forest")))
    return RiskModel(GBTClassificationModel.load(f"{path}/booster"), forest, facts["names"], facts["weight"], Thresholds(**facts["thresholds"]), facts["version"], facts["spec"])


FEATURE_SETS = {"hot": HOT_FEATURES, "hot_and_graph": FEATURES, "graph_only": WARM_FEATURES}


def experiments(train: DataFrame, early_stop: DataFrame, valid: DataFrame, params: dict, rounds: int, sets: dict[str, list[str]] | None = None) -> dict[str, dict]:
    """Rules, and a model per set of features, each at its own operating point on valid."""
    out = {}
    ruled = apply_rules(valid)
    out["rules"] = metrics.evaluate_at(ruled, "rule_score", "is_fraud", 1.0, "amount").first().asDict()
    for name, names in (sets or FEATURE_SETS).items():
        scored = trees.predict(trees.fit(train, early_stop, names, params, rounds=rounds), valid, names)
        point = metrics.operating_point(scored, "p_model", "is_fraud").first()
        found = metrics.evaluate_at(scored, "p_model", "is_fraud", point["threshold"] if point else 1.1, "amount").first().asDict()
        out[name] = found | {"pr_auc": metrics.pr_auc(scored, "p_model", "is_fraud").first()["pr_auc"]}
    return out


def build(train: DataFrame, early_stop: DataFrame, valid: DataFrame, params: dict, rounds: int, weight: float, cfg: ModelConfig = MODEL) -> RiskModel:
    """Booster, forest and thresholds; thresholds come from valid alone."""
    booster = trees.fit(train, early_stop, FEATURES, params, rounds=rounds)
    forest = forests.fit(train, NUMERIC_FEATURES, cfg=cfg)
    draft = RiskModel(booster, forest, FEATURES, weight, Thresholds(None, None))
    draft.thresholds = choose(score(draft, valid, explain=False), "risk", "is_fraud")
    return draft


def evaluate_test(model: RiskModel, test: DataFrame, audit_path: str) -> dict:
    """The locked split, opened by ALLOW_TEST=1, with thresholds as they are; each run is added to the audit log."""
    guard("test")
    scored = score(model, test, explain=False)
    found = metrics.evaluate_at(scored, "risk", "is_fraud", model.thresholds.review if model.thresholds.review is not None else 1.1, "amount", model.thresholds.hold).first().asDict()
    spark = test.sparkSession
    spark.createDataFrame([(int(time.time()), model.version, json.dumps(found, sort_keys=True))], "at long, version string, result string").write.mode("append").json(audit_path)
    return found
