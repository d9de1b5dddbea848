"""What the service answers: alerts, single transactions, what-if scores, metrics and health, as DataFrames and small mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STREAM
from ..functions.scalar import heartbeat
from ..operators.joins import attach_snapshots
from ..operators.predicates import is_alert
from ..operators.windows import hot_features
from ..schemas import FEATURE_SPEC_VERSION, split_valid


def recent_alerts(scored: DataFrame, decision: str | None = None, limit: int = 50) -> DataFrame:
    """The newest alerts, of one decision if given."""
    if not 1 <= limit <= STREAM.alerts_kept:
        raise ValueError(f"limit must be within 1 and {STREAM.alerts_kept}")
    wanted = scored.where(is_alert()) if decision is None else scored.where(is_alert() & (F.col("decision") == decision))
    return wanted.orderBy(F.desc("scored_ts"), F.desc("txn_id")).limit(limit)


def transaction(scored: DataFrame, txn_id) -> DataFrame:
    """The scored row of one transaction; no row if there is none."""
    return scored.where(F.col("txn_id") == F.lit(txn_id)).orderBy("scored_ts").limit(1)


def what_if(candidates: DataFrame, past: DataFrame, accounts: DataFrame, snapshots: DataFrame, calendar: list[int], scored: DataFrame, score) -> DataFrame:
    """Scores of events that are not kept. Features come from the past of the candidates' accounts and entities; nothing is written,
    so asking again changes nothing. A candidate that was already scored gets its stored row's risk and decision. Each candidate is
    judged alone against the past: others of the same call are not in it."""
    valid, _ = split_valid(candidates, ["amount", "account_id", "channel", "status"])
    keyed = valid.withColumn("_candidate", F.col("txn_id"))
    names = [c for c in past.columns if c in valid.columns]
    touched = None
    for k in ("account_id", "device_id", "ip", "merchant_id"):
        hit = past.join(keyed.select(k, "_candidate", F.col("ms").alias("_at")).distinct(), k).where(F.col("ms") <= F.col("_at")).select(*[F.col(c) for c in names], "_candidate")
        touched = hit if touched is None else touched.union(hit)
    # a world of its own per candidate: keys carry its name
    world = touched.distinct().where("txn_id <> _candidate").withColumn("_asked", F.lit(False)).unionByName(keyed.select(*names, "_candidate").withColumn("_asked", F.lit(True)))
    tag = lambda c: F.concat_ws("|", "_candidate", F.col(c).cast("string"))
    apart = world.withColumns({c: tag(c) for c in ("account_id", "device_id", "ip", "merchant_id")} | {"_account": F.col("account_id"), "txn_id": tag("txn_id")})
    own_accounts = accounts.join(world.select("account_id", "_candidate").distinct(), "account_id").withColumn("account_id", tag("account_id")).drop("_candidate")
    found = hot_features(apart, own_accounts).where("_asked").withColumns({"account_id": F.col("_account"), "txn_id": F.col("_candidate")})
    out = score(attach_snapshots(found, snapshots, calendar).drop("_account", "_asked", "_candidate"))
    stored = scored.select("txn_id", F.col("risk").alias("_risk"), F.col("decision").alias("_decision"))
    merged = out.join(stored, "txn_id", "left").withColumns({"already_processed": F.col("_decision").isNotNull(), "state_updated": F.lit(False), "risk": F.coalesce("_risk", "risk"), "decision": F.coalesce("_decision", "decision"), "stale": F.col("secs_since_last") < 0})
    return merged.drop("_risk", "_decision")


def metrics(scored: DataFrame, quarantined: int = 0, progress: dict | None = None) -> dict:
    """Counters, throughput, latency and the watermark."""
    row = scored.agg(F.count("*").alias("processed"), F.count(F.when(is_alert(), 1)).alias("alerts"), F.count(F.when(F.col("decision") == "HOLD", 1)).alias("holds"), F.max("ms").alias("watermark_ms"), F.percentile("latency_ms", F.lit(0.5)).alias("p50_ms"), F.percentile("latency_ms", F.lit(0.95)).alias("p95_ms")).first().asDict()
    p = progress or {}
    return row | {"quarantined": quarantined, "rows_per_second": p.get("processedRowsPerSecond"), "lag": lag(p)}


def lag(progress: dict) -> int | None:
    """Rows that the source has and the query has not read; None where the source does not tell."""
    found = [s["metrics"].get("numFilesOutstanding") or s["metrics"].get("maxOffsetsBehindLatest") for s in progress.get("sources", []) if s.get("metrics")]
    return int(found[0]) if found and found[0] is not None else None


def health(spark, model_version: str | None, calendar: list[int], heartbeat_age: float | None) -> dict:
    """What is up; never raises."""
    try:
        label = spark.range(1).select(heartbeat(F.lit(heartbeat_age).cast("double"))).first()[0]
        status = "ok" if model_version and label == "live" else "degraded"
    except Exception as problem:  # noqa: BLE001  the answer must come in any case
        return {"status": "degraded", "problem": str(problem)[:200]}
    return {"status": status, "model_version": model_version, "feature_spec_version": FEATURE_SPEC_VERSION, "latest_snapshot_ms": max(calendar, default=None), "heartbeat": label}
