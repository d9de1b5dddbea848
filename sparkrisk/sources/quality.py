"""Checks of a generated data set: each gives a name, whether it passed, and what was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAY, HOUR
from ..functions.scalar import fingerprint
from ..operators import aggregates, windows
from ..schemas import CATEGORIES, CHANNELS, LABEL_COLUMNS, STATUSES

MINUTE = 60_000


def check(name: str, passed, measured) -> dict:
    return {"check": name, "passed": bool(passed), "measured": str(measured)}


def schema_checks(t: dict[str, DataFrame]) -> list[dict]:
    e, known = t["events"], t["accounts"].select("account_id", "created_ms")
    row = e.agg(
        F.count("*").alias("n"), F.countDistinct("txn_id").alias("ids"), F.min("amount").alias("least"), F.count(F.when(~F.col("channel").isin(CHANNELS), 1)).alias("channels"),
        F.count(F.when(~F.col("status").isin(STATUSES), 1)).alias("statuses"), F.count(F.when(~F.col("merchant_category").isin(CATEGORIES), 1)).alias("categories"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in ("ms", "account_id", "device_id", "ip", "lat", "lon")],
    ).first()
    early = e.join(known, "account_id").where("ms < created_ms").count()
    return [
        check("unique ids", row["n"] == row["ids"], row["ids"]), check("positive amounts", row["least"] > 0, row["least"]), check("no labels in events", not LABEL_COLUMNS & set(e.columns), e.columns),
        *[check(f"known {k}", row[k] == 0, row[k]) for k in ("channels", "statuses", "categories")], check("no nulls", not any(row[f"null_{c}"] for c in ("ms", "account_id", "device_id", "ip", "lat", "lon")), "nulls"),
        check("accounts exist before their events", early == 0, early),
    ]


def volume_checks(t: dict[str, DataFrame], low: float = 0.0005, high: float = 0.05) -> list[dict]:
    share = t["labels"].agg(F.avg("is_fraud")).first()[0]
    kinds = {r["fraud_type"]: r["n"] for r in aggregates.prevalence(t["labels"]).collect()}
    return [check("fraud share", low <= share <= high, share), *[check(f"{k} present", kinds.get(k, 0) > 0, kinds.get(k, 0)) for k in ("VELOCITY", "ATO", "CARD_TESTING", "RING")]]


def pattern_checks(t: dict[str, DataFrame]) -> list[dict]:
    e = t["events"].join(t["labels"], "txn_id")
    testing = aggregates.reach(e.where("fraud_type = 'CARD_TESTING'"), "attack_id", HOUR).agg(F.min("accounts")).first()[0]
    takeover = windows.account_features(t["events"], t["accounts"]).join(t["labels"].where("fraud_type = 'ATO'"), "txn_id")
    fast = takeover.groupBy("attack_id").agg(F.max(((F.col("geo_speed_kmh") >= 900) & (F.col("new_device") == 1)).cast("int")).alias("hit")).agg(F.avg("hit")).first()[0]
    ring = aggregates.spans(e.where("fraud_type = 'RING'"), "ring_id")
    least, days = ring.agg(F.min("accounts"), F.min((F.col("last_ms") - F.col("first_ms")) / DAY)).first()
    uses = e.where("ring_id is not null").groupBy("ring_id", "device_id").agg(F.min("ms").alias("start"))
    reused = windows.earlier_groups(uses, "device_id", "ring_id", "start").where("reused").count()
    return [check("card testing reaches many accounts in an hour", testing >= 5, testing), check("takeovers are fast and on new devices", fast >= 0.8, fast), check("rings have members", least >= 3, least), check("rings last", days >= 3, days), check("a ring reuses a device", reused > 0, reused)]


def hard_negative_checks(t: dict[str, DataFrame]) -> list[dict]:
    honest = t["events"].join(t["labels"].where("is_fraud = 0").select("txn_id"), "txn_id")
    sprees = windows.bursts(honest, 5, HOUR).count()
    small = windows.bursts(honest, 4, 20 * MINUTE, 100.0).count()
    families = honest.groupBy("device_id").agg(F.countDistinct("account_id").alias("n")).where("n >= 2").count()
    return [check("honest sprees", sprees > 0, sprees), check("honest runs of small payments", small > 0, small), check("shared honest devices", families > 0, families)]


def determinism(make) -> dict:
    """Two builds have equal fingerprints."""
    first, second = ({n: fingerprint(f).first() for n, f in make().items()} for _ in range(2))
    return check("two builds are equal", first == second, {n: r["n"] for n, r in first.items()})


def run_all(t: dict[str, DataFrame]) -> list[dict]:
    return schema_checks(t) + volume_checks(t) + pattern_checks(t) + hard_negative_checks(t)
