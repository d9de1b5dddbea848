"""Aggregations for monitoring, reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .predicates import is_alert


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def percentiles(column: str, shares: list[float]) -> list[Column]:
    """Exact linear percentiles, as p50, p99_9 and so on."""
    return [F.percentile(column, F.lit(s)).alias(f"p{100 * s:g}".replace(".", "_")) for s in shares]


def nearest_rank(frame: DataFrame, column: str, share: float) -> DataFrame:
    """The value at place round(share * (n - 1)), halves to even, of the sorted values."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    total = counts.agg(F.sum("n").alias("total"))
    placed = counts.withColumn("upto", upto).join(F.broadcast(total))  # one row
    return placed.where(F.col("upto") > F.bround(F.lit(share) * (F.col("total") - 1), 0)).agg(F.min(column).alias("value"))


def riskiest_merchants(scored: DataFrame, n: int = 10) -> DataFrame:
    out = scored.groupBy("merchant_id").agg(F.count("*").alias("events"), F.avg("risk").alias("avg_risk"), count_if(is_alert()).alias("alerts"))
    return out.orderBy(F.desc("avg_risk"), "merchant_id").limit(n)


def by_hour(scored: DataFrame) -> DataFrame:
    """Events, alerts, holds and the alert rate of each hour."""
    hour = (F.floor(F.col("ms") / 3_600_000) * 3_600_000).alias("hour_ms")
    return scored.groupBy(hour).agg(F.count("*").alias("events"), count_if(is_alert()).alias("alerts"), count_if(F.col("decision") == "HOLD").alias("holds"), F.avg(is_alert().cast("double")).alias("alert_rate"))


def latency(scored: DataFrame, column: str = "latency_ms") -> DataFrame:
    return scored.agg(*percentiles(column, [0.5, 0.95, 0.99]))


def scorecard(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Per fraud pattern: labelled, caught and recall."""
    joined = scored.select("txn_id", "decision").join(labels, "txn_id").where("is_fraud = 1")
    out = joined.groupBy("fraud_type").agg(F.count("*").alias("labelled"), count_if(is_alert()).alias("caught"))
    return out.withColumn("recall", ratio("caught", "labelled"))


def scorecard_totals(scored: DataFrame, labels: DataFrame) -> DataFrame:
    fraud = F.col("is_fraud") == 1
    out = scored.select("txn_id", "decision").join(labels, "txn_id").agg(count_if(is_alert()).alias("alerts"), count_if(fraud).alias("fraud"), count_if(is_alert() & fraud).alias("caught"))
    return out.withColumns({"precision": ratio("caught", "alerts"), "recall": ratio("caught", "fraud")})


def top_merchants(scored: DataFrame, n: int = 10) -> DataFrame:
    out = scored.groupBy("merchant_id").agg(F.count("*").alias("events"), count_if(is_alert()).alias("alerts"), F.avg("risk").alias("avg_risk"))
    return out.where("alerts > 0").orderBy(F.desc("alerts"), F.desc("avg_risk"), "merchant_id").limit(n)


def top_accounts(scored: DataFrame, n: int = 10) -> DataFrame:
    out = scored.groupBy("account_id").agg(F.count("*").alias("events"), count_if(is_alert()).alias("alerts"), F.max("risk").alias("max_risk"))
    return out.where("alerts > 0").orderBy(F.desc("max_risk"), "account_id").limit(n)


def profile(features: DataFrame, names: list[str]) -> DataFrame:
    """Per feature: min, p50, mean, p99, max and the share of zeros. All features in one pass."""
    one = lambda c: F.struct(F.lit(c).alias("feature"), F.min(c).cast("double").alias("low"), F.percentile(c, F.lit(0.5)).alias("p50"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.99)).alias("p99"), F.max(c).cast("double").alias("high"), F.avg((F.col(c) == 0).cast("double")).alias("zero_share"))
    return features.agg(F.array(*[one(c) for c in names]).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def spans(events: DataFrame, key: str) -> DataFrame:
    """First and last time, events and distinct accounts of each key."""
    return events.groupBy(key).agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("events"), F.countDistinct("account_id").alias("accounts"))


def prevalence(labels: DataFrame) -> DataFrame:
    out = labels.groupBy("fraud_type").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def reach(events: DataFrame, key: str, width: int) -> DataFrame:
    """Distinct accounts of each key within `width` after its first event."""
    first = F.min("ms").over(Window.partitionBy(key))
    return events.withColumn("_first", first).where(F.col("ms") < F.col("_first") + width).groupBy(key).agg(F.countDistinct("account_id").alias("accounts"))


def distribution(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), *percentiles(column, [0.5, 0.9, 0.95, 0.99, 0.999]), F.max(column).alias("high"))


def cap_table(members: DataFrame, caps: list[int], column: str = "members") -> DataFrame:
    """For each candidate cap: entities and member pairs that it would drop. One pass over the counts."""
    pairs = F.col(column) * (F.col(column) - 1) / 2
    one = lambda cap: F.struct(F.lit(cap).alias("cap"), count_if(F.col(column) > cap).alias("dropped_entities"), F.coalesce(F.sum(F.when(F.col(column) > cap, pairs)), F.lit(0.0)).alias("dropped_pairs"), F.sum(pairs).alias("all_pairs"))
    return members.agg(F.array(*[one(c) for c in caps]).alias("caps")).select(F.explode("caps").alias("c")).select("c.*")


def spreads(frame: DataFrame, names: list[str], floor: float = 1e-12) -> DataFrame:
    """Per feature its median and spread: the interquartile range, else the standard deviation, else the floor."""

    def one(c: str) -> Column:
        iqr = F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
        return F.struct(F.lit(c).alias("feature"), F.percentile(c, F.lit(0.5)).alias("median"), F.greatest(F.when(iqr > 0, iqr).otherwise(F.stddev_pop(c)), F.lit(floor)).alias("spread"))

    return frame.agg(F.array(*[one(c) for c in names]).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def quantile_table(frame: DataFrame, column: str, points: int) -> list[float]:
    """That many evenly spaced quantiles, on the driver."""
    return frame.agg(F.percentile(column, [k / (points - 1) for k in range(points)]).alias("q")).first()["q"]


def staleness(events: DataFrame) -> DataFrame:
    """Hours between events and the snapshots that they were given."""
    hours = events.where("graph_snapshot_ms is not null").select(((F.col("ms") - F.col("graph_snapshot_ms")) / 3_600_000.0).alias("hours"))
    return hours.agg(*percentiles("hours", [0.5, 0.95]), F.max("hours").alias("high"))


def throughput(scored: DataFrame) -> DataFrame:
    """Rows per second between the first and the last score."""
    seconds = (F.max("scored_ts") - F.min("scored_ts")) / 1000.0
    return scored.agg(F.count("*").alias("rows"), F.when(seconds > 0, F.count("*") / seconds).alias("rows_per_second"), *percentiles("latency_ms", [0.5, 0.95, 0.99]))


def unique_and_raw(scored: DataFrame, key: str = "txn_id") -> DataFrame:
    return scored.agg(F.countDistinct(key).alias("unique_rows"), F.count("*").alias("raw_rows"))


def mean_contributions(contributions: DataFrame, n: int = 20) -> DataFrame:
    """Of arrays of (name, value): the features with the largest mean absolute value."""
    flat = contributions.select(F.explode("contributions").alias("c")).select("c.name", "c.value")
    return flat.groupBy("name").agg(F.avg(F.abs("value")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "name").limit(n)


def group_counts(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n"))


def counter_deltas(totals: DataFrame, published: DataFrame) -> DataFrame:
    """name and how much its total has grown since it was last published."""
    return totals.join(published.withColumnRenamed("total", "before"), "name", "left").select("name", (F.col("total") - F.coalesce("before", F.lit(0))).alias("delta")).where("delta <> 0")
