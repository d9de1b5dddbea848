"""Splits, rules, decisions and guards."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RULES, SPLITS, RuleConfig, SplitConfig
from .ranged import range_of


def day_ms(date: str) -> int:
    return int(datetime.fromisoformat(date).replace(tzinfo=timezone.utc).timestamp() * 1000)


def between(column: str, low, high) -> Column:
    """low <= column < high."""
    return (F.col(column) >= low) & (F.col(column) < high)


def split_of(ms: str = "ms", cfg: SplitConfig = SPLITS) -> Column:
    out = F.lit("none")
    for name, low, high in reversed(cfg.splits):
        out = F.when(between(ms, day_ms(low), day_ms(high)), name).otherwise(out)
    return out


def tag_splits(frame: DataFrame, ms: str = "ms", cfg: SplitConfig = SPLITS) -> DataFrame:
    """split and in_burn_in."""
    return frame.withColumns({"split": split_of(ms, cfg), "in_burn_in": between(ms, day_ms(cfg.burn_in[0]), day_ms(cfg.burn_in[1])).cast("tinyint")})


def guard(split: str, cfg: SplitConfig = SPLITS) -> None:
    """A locked split opens only where ALLOW_TEST=1 is set."""
    if split in cfg.locked and os.environ.get("ALLOW_TEST") != "1":
        raise PermissionError(f"split {split!r} is locked; ALLOW_TEST=1 opens it")


def select_split(frame: DataFrame, split: str, cfg: SplitConfig = SPLITS) -> DataFrame:
    guard(split, cfg)
    return frame.where((F.col("split") == split) & (F.col("in_burn_in") == 0))


def rules(cfg: RuleConfig = RULES) -> dict[str, Column]:
    c = F.col
    return {
        "r1_velocity": c("acct_cnt_5m") >= cfg.r1_cnt_5m,
        "r2_ato": (c("geo_speed_kmh") >= cfg.r2_speed) & (c("new_device") == cfg.r2_new_device),
        "r3_card_testing": (c("dev_accts_1h") >= cfg.r3_dev_accts_1h) | ((c("acct_small_1h") >= cfg.r3_small_1h) & (c("acct_declines_1h") >= cfg.r3_declines_1h)),
        "r4_ring": (c("dev_accts_30d") >= cfg.r4_dev_accts_30d) & (c("account_age_days") < cfg.r4_age_days),
    }


def apply_rules(features: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """A flag per rule, whether any fired, and how many did."""
    fired = rules(cfg)
    out = features.withColumns({n: c.cast("int") for n, c in fired.items()})
    return out.withColumns({"rule_flag": F.greatest(*fired) > 0, "rule_score": sum((F.col(n) for n in fired), F.lit(0)).cast("double")})


def firing_rates(ruled: DataFrame) -> DataFrame:
    return ruled.agg(*[F.avg(n).alias(n) for n in rules()])


def decide(risk: str, review_at: float | None, hold_at: float | None) -> Column:
    """HOLD, REVIEW or ALLOW; thresholds are inclusive, an absent one never applies."""
    out = F.lit("ALLOW")
    if review_at is not None:
        out = F.when(F.col(risk) >= review_at, "REVIEW").otherwise(out)
    if hold_at is not None:
        out = F.when(F.col(risk) >= hold_at, "HOLD").otherwise(out)
    return out


def is_alert(decision: str = "decision") -> Column:
    return F.col(decision) != "ALLOW"


def known_fraud(labels: DataFrame, at_ms) -> DataFrame:
    """Fraud whose label is there before the given time."""
    return labels.where((F.col("is_fraud") == 1) & (F.col("label_ms") < at_ms))


def order_violations(frame: DataFrame, *order: str) -> DataFrame:
    """One row: how many rows come before their predecessor by `position` in the order. Rows of one position follow each other in the
    order, so that the number is the same at each run. Inside ranges of positions rows are compared with their predecessors, and each
    range's last row with the next one's first."""
    ranged = frame.select("position", F.struct(*order).alias("k"), range_of(frame, "position").alias("part"))
    inside = ranged.withColumn("before", F.lag("k").over(Window.partitionBy("part").orderBy("position", "k"))).select((F.col("k") < F.col("before")).alias("bad"))
    place = F.struct("position", "k")
    edges = ranged.groupBy("part").agg(F.min(place)["k"].alias("first"), F.max(place)["k"].alias("last"))
    across = edges.withColumn("before", F.lag("last").over(Window.orderBy("part"))).select((F.col("first") < F.col("before")).alias("bad"))
    return inside.union(across).agg(F.count(F.when(F.col("bad"), 1)).alias("violations"))


def sampled(frame: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the smallest hashes of key and seed: the same ones at each call."""
    return frame.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def on_hold(events: DataFrame, holds: DataFrame, ttl: int) -> DataFrame:
    """Events with whether their account was held within the ttl before them."""
    held = holds.select("account_id", F.col("ms").alias("hold_ms"))
    hits = events.join(held, "account_id").where((F.col("hold_ms") < F.col("ms")) & (F.col("ms") <= F.col("hold_ms") + ttl)).select("txn_id").distinct()
    return events.join(hits.withColumn("account_on_hold", F.lit(True)), "txn_id", "left").fillna(False, ["account_on_hold"])
