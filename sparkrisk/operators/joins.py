"""Joins: point in time, validated, and between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GRAPH, GraphConfig

#: Entries of a calendar that travel as one array literal; daily snapshots of a century are fewer.
MOST_CALENDAR = 50_000


def latest_at(ms: Column, calendar: list[int]) -> Column:
    """The last entry of an ascending calendar at or before a time; null before the first."""
    if len(calendar) > MOST_CALENDAR:
        raise ValueError("this calendar is too long for an array: use asof_by_key with a constant key")
    if not calendar:
        return F.lit(None).cast("long")
    return F.array_max(F.filter(F.array(*[F.lit(int(x)) for x in sorted(calendar)]), lambda x: x <= ms))


def asof_by_key(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of its key's last right row at (or, if strict, only before) its time. One sort per key of both
    tables together."""
    marks = right.select(F.col(key), F.col(right_at).alias("_at"), F.lit(2 if strict else 0).alias("_side"), F.struct(F.col(right_at).alias("_asof"), *values).alias("_value"))
    rows = left.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = F.last("_value", ignorenulls=True).over(Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_seen", seen).where("_row is not null")
    return found.select("_row.*", F.col("_seen._asof").alias(f"{right_at}_asof"), *[F.col(f"_seen.{v}").alias(v) for v in values])


def attach_snapshots(events: DataFrame, snapshots: DataFrame, calendar: list[int], cfg: GraphConfig = GRAPH) -> DataFrame:
    """Events with the graph features of the last snapshot at or before them. First the snapshot is chosen, then the account looked up
    in it: an account that is not there gets the defaults, never an older snapshot's values."""
    placed = events.withColumn("graph_snapshot_ms", latest_at(F.col("ms"), calendar))
    values = snapshots.select(F.col("snapshot_ms").alias("graph_snapshot_ms"), "account_id", *[n for n, _ in cfg.defaults])
    joined = placed.join(values, ["graph_snapshot_ms", "account_id"], "left")
    return joined.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(float(d))) for n, d in cfg.defaults})


def unique_on(frame: DataFrame, key: str) -> DataFrame:
    """The frame, once it is sure that no key repeats."""
    if not frame.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return frame


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    return unique_on(left, key).join(unique_on(right, key), key, how)


def training_table(features: DataFrame, snapshots: DataFrame, calendar: list[int], labels: DataFrame, cfg: GraphConfig = GRAPH) -> DataFrame:
    """Features, graph features and, last of all, labels."""
    return attach_snapshots(features, snapshots, calendar, cfg).join(labels, "txn_id", "left")


def load_split(features: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    from .predicates import select_split

    return select_split(features, split).join(labels, "txn_id")


def load_many(features: DataFrame, labels: DataFrame, splits: list[str]) -> dict[str, DataFrame]:
    """One joined plan, filtered per split."""
    from .predicates import select_split

    joined = features.join(labels, "txn_id")
    return {s: select_split(joined, s) for s in splits}


def seeds(labels: DataFrame, events: DataFrame, at_ms) -> DataFrame:
    """Accounts with fraud that is known before the given time."""
    from .predicates import known_fraud

    return known_fraud(labels, at_ms).select("txn_id").join(events.select("txn_id", "account_id"), "txn_id").select("account_id").distinct()


def previous_by_kind(events: DataFrame, key: str, is_target: Column, is_anchor: Column, values: list[str]) -> DataFrame:
    """Target rows with the values of their key's last anchor row before them."""
    w = Window.partitionBy(key).orderBy("ms", "txn_id").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.last(F.when(is_anchor, F.col(v)), ignorenulls=True).over(w).alias(f"anchor_{v}") for v in values]
    return events.select("*", is_target.alias("_target"), *out).where("_target").drop("_target")


def parity(live: DataFrame, offline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows in both, missing on either side, and the largest absolute difference per column."""
    a = live.select(key, F.lit(1).alias("_live"), *[F.col(c).cast("double").alias(f"{c}_live") for c in columns])
    b = offline.select(key, F.lit(1).alias("_offline"), *[F.col(c).cast("double").alias(f"{c}_offline") for c in columns])
    count = lambda c: F.count(F.when(c, 1))
    live_in, offline_in = F.col("_live").isNotNull(), F.col("_offline").isNotNull()
    gaps = [F.max(F.abs(F.col(f"{c}_live") - F.col(f"{c}_offline"))).alias(f"max_diff_{c}") for c in columns]
    return a.join(b, key, "full_outer").agg(count(live_in & offline_in).alias("matched"), count(live_in & ~offline_in).alias("live_only"), count(offline_in & ~live_in).alias("offline_only"), *gaps)


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with its name."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").union(only(b, a, "right"))
