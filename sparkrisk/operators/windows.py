"""The behavioural features of an event, from what came before it.

Range features look at [t - w, t) in event time, so events of the same millisecond do not see each other; prefix features follow the
total order (ms, txn_id), in which the later of two tied events sees the earlier. All account features share one partitioning and one
sort, by account and total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FEATURES, FeatureConfig
from ..functions.scalar import age_days, clip, haversine_km, hour_of
from . import fanout

KEY = "account_id"
ORDER = ("ms", "txn_id")


def trailing(width: int, key: str = KEY):
    """[t - width, t) on epoch milliseconds."""
    return Window.partitionBy(key).orderBy("ms").rangeBetween(-width, -1)


def ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy(*ORDER)


def before(*keys: str):
    """All rows before this one in the total order."""
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, -1)


def context(cfg: FeatureConfig = FEATURES) -> dict[str, Column]:
    hour = hour_of("ms")
    return {
        "log_amount": F.log1p("amount"),
        "hour_of_day": hour,
        "is_night": ((hour >= cfg.night[0]) & (hour < cfg.night[1])).cast("int"),
        "is_online": (F.col("channel") == "ONLINE").cast("int"),
        "is_international": (F.col("country") != cfg.home_country).cast("int"),
    }


def velocity(cfg: FeatureConfig = FEATURES) -> dict[str, Column]:
    count = lambda w: F.count(F.lit(1)).over(trailing(w))
    when = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(trailing(cfg.hour)), F.lit(0))
    return {
        "acct_cnt_5m": count(cfg.short),
        "acct_cnt_1h": count(cfg.hour),
        "acct_cnt_24h": count(cfg.day),
        "acct_amt_24h": F.coalesce(F.sum("amount").over(trailing(cfg.day)), F.lit(0.0)),
        "acct_merchants_1h": F.size(F.collect_set("merchant_id").over(trailing(cfg.hour))),
        "acct_declines_1h": when(F.col("status") == "DECLINED"),
        "acct_small_1h": when(F.col("amount") < cfg.small_amount),
    }


def deviation(cfg: FeatureConfig = FEATURES) -> dict[str, Column]:
    approved = F.col("status") == "APPROVED"
    total = lambda x: F.coalesce(F.sum(F.when(approved, x)).over(before(KEY)), F.lit(0.0))
    n, s, ss = total(F.lit(1.0)), total(F.col("amount")), total(F.col("amount") * F.col("amount"))
    mean = s / F.nullif(n, F.lit(0.0))
    spread = F.when(n >= 2, F.sqrt(F.greatest((ss - s * s / F.nullif(n, F.lit(0.0))) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0)))).otherwise(0.0)
    floor = F.greatest(spread, cfg.z_floor_ratio * mean, F.lit(cfg.z_floor))
    gap = (F.col("ms") - F.lag("ms").over(ordered(KEY))) / 1000.0
    bucket = F.floor(hour_of("ms") / cfg.bucket_hours)
    seen = F.count(F.lit(1)).over(before(KEY))
    in_bucket = F.count(F.lit(1)).over(Window.partitionBy(KEY, bucket).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1))
    return {
        "secs_since_last": F.when(gap.isNull(), cfg.gap_default).otherwise(F.least(gap, F.lit(cfg.gap_default))),
        "amount_zscore": F.when(n >= cfg.z_least_prior, clip((F.col("amount") - mean) / floor, *cfg.z_clip)).otherwise(0.0),
        "amount_to_mean": F.when(mean > 0, F.least(F.col("amount") / mean, F.lit(cfg.to_mean_clip))).otherwise(cfg.to_mean_default),
        "hour_unusualness": 1.0 - (in_bucket + 1) / (seen + cfg.buckets),
        "acct_history_cnt": seen,
    }


def novelty(cfg: FeatureConfig = FEATURES) -> dict[str, Column]:
    """Needs home_city, home_lat and home_lon (null if the account is unknown)."""
    last, used = F.lag("ms").over(ordered(KEY)), F.lag("ms").over(ordered(KEY, "device_id"))
    first = lambda c: F.row_number().over(ordered(KEY, c)) == 1
    way = haversine_km(F.lag("lat").over(ordered(KEY)), F.lag("lon").over(ordered(KEY)), F.col("lat"), F.col("lon"))
    hours = F.greatest((F.col("ms") - last) / 1000.0, F.lit(cfg.least_elapsed)) / 3600.0
    speed = F.when(way.isNotNull() & last.isNotNull(), F.least(way / hours, F.lit(cfg.speed_cap)))
    return {
        # devices are forgotten when the account's next event comes more than the retention later
        "new_device": (used.isNull() | (used < last - cfg.device_retention)).cast("int"),
        "new_merchant": first("merchant_id").cast("int"),
        "new_city": (first("city") & ~F.coalesce(F.col("city") == F.col("home_city"), F.lit(False))).cast("int"),
        "km_from_home": F.coalesce(haversine_km("home_lat", "home_lon", "lat", "lon"), F.lit(0.0)),
        "geo_speed_kmh": F.coalesce(speed, F.lit(cfg.speed_default)),
    }


def with_facts(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Events with their account's facts, null where the account is unknown. The join is on the key that the windows need, so both
    sides are dealt out by it once."""
    return events.join(accounts, KEY, "left")


def account_features(events: DataFrame, accounts: DataFrame, cfg: FeatureConfig = FEATURES) -> DataFrame:
    """All features but the fan-out counts."""
    age = F.coalesce(age_days("ms", "created_ms"), F.lit(0.0))
    columns = context(cfg) | velocity(cfg) | deviation(cfg) | {"account_age_days": age} | novelty(cfg)
    known = with_facts(events, accounts)
    return known.select("*", *[c.alias(n) for n, c in columns.items()]).drop("created_ms", "home_city", "home_lat", "home_lon")


def hot_features(events: DataFrame, accounts: DataFrame, cfg: FeatureConfig = FEATURES) -> DataFrame:
    """Events with their 30 features."""
    counts = fanout.last_use_counts(
        events,
        [
            fanout.Count("dev_accts_1h", "device_id", KEY, cfg.hour), fanout.Count("dev_accts_30d", "device_id", KEY, cfg.month),
            fanout.Count("ip_accts_1h", "ip", KEY, cfg.hour), fanout.Count("ip_accts_30d", "ip", KEY, cfg.month),
            fanout.Count("mer_accts_30d", "merchant_id", KEY, cfg.month), fanout.Count("acct_devices_30d", KEY, "device_id", cfg.month),
        ],
    )
    return account_features(events, accounts, cfg).join(counts, "txn_id")


def bursts(events: DataFrame, least: int, width: int, most_amount: float | None = None, key: str = KEY) -> DataFrame:
    """Keys with at least `least` events, of at most that amount, within `width`."""
    some = events if most_amount is None else events.where(F.col("amount") < most_amount)
    early = F.lag("ms", least - 1).over(ordered(key))
    return some.select(key, (F.col("ms") - early).alias("span")).where(F.col("span") <= width).select(key).distinct()


def first_of_day(events: DataFrame, key: str = KEY) -> DataFrame:
    """The first event of each key and day."""
    day = F.floor(F.col("ms") / 86_400_000)
    return events.withColumn("day", day).withColumn("n", F.row_number().over(Window.partitionBy(key, "day").orderBy(*ORDER))).where("n = 1").drop("n")


def slots(frame: DataFrame, key: str, order: str) -> DataFrame:
    """Rows numbered from 0 within their key."""
    return frame.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def earliest_copy(scored: DataFrame, key: str = "txn_id", order: tuple[str, ...] = ("scored_ts", "stream_id")) -> DataFrame:
    """Of the rows of a key the one scored first."""
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def daily_fanout(events: DataFrame, entity: str, lookback: int, member: str = KEY, cadence: int = 86_400_000) -> DataFrame:
    """Members of each entity in [T - lookback, T), for each daily boundary T after its uses. Each use is sent to its boundaries."""
    first = F.floor(F.col("ms") / cadence) + 1
    last = F.floor((F.col("ms") + lookback) / cadence)
    spread = events.select(entity, member, F.explode(F.sequence(first, last)).alias("day")).distinct()
    return spread.groupBy(entity, (F.col("day") * cadence).alias("boundary_ms")).agg(F.count("*").alias("members"))


def earlier_groups(uses: DataFrame, entity: str, group: str, start: str) -> DataFrame:
    """Uses with whether an earlier group used the entity before."""
    return uses.withColumn("reused", F.min(start).over(Window.partitionBy(entity)) < F.col(start))


def weighted_pick(options: DataFrame, key: str, weight: str, order: str, u: str) -> DataFrame:
    """Of each key's options, in order, the first whose share of summed weights exceeds u."""
    w = Window.partitionBy(key).orderBy(order)
    so_far, total = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(weight).over(Window.partitionBy(key))
    marked = options.withColumn("_end", so_far / total).where(F.col("_end") > F.col(u))
    return marked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_end")
