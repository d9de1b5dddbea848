"""Schemas, the order of features, and the checks at the boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
FEATURE_SPEC_VERSION = "fs1"

# Feature names in the order in which models read them.
HOT_FEATURES = [
    "log_amount", "hour_of_day", "is_night", "is_online", "is_international", "merchant_category", "acct_cnt_5m",
    "acct_cnt_1h", "acct_cnt_24h", "acct_amt_24h", "acct_merchants_1h", "acct_declines_1h", "acct_small_1h",
    "secs_since_last", "amount_zscore", "amount_to_mean", "hour_unusualness", "account_age_days", "acct_history_cnt",
    "new_device", "acct_devices_30d", "new_merchant", "new_city", "km_from_home", "geo_speed_kmh", "dev_accts_1h",
    "dev_accts_30d", "ip_accts_1h", "ip_accts_30d", "mer_accts_30d",
]
WARM_FEATURES = ["graph_degree", "graph_clustering", "community_size", "community_shared_devices", "community_young_share", "ppr_risk"]
FEATURES = HOT_FEATURES + WARM_FEATURES
NUMERIC_FEATURES = [f for f in FEATURES if f != "merchant_category"]
# Category levels in the order of their codes.
CATEGORIES = ["grocery", "fuel", "restaurants", "pharmacy", "utilities", "ecommerce", "electronics", "travel", "digital_goods", "gift_cards_wallet"]
# Columns that no model may read.
FORBIDDEN = {"txn_id", "account_id", "merchant_id", "device_id", "ip", "attack_id", "ring_id"}
LABEL_COLUMNS = {"is_fraud", "fraud_type", "attack_id", "ring_id", "label_available_at"}
CHANNELS, STATUSES, DECISIONS = ["POS", "ONLINE"], ["APPROVED", "DECLINED"], ["ALLOW", "REVIEW", "HOLD"]
IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"


TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "tinyint": T.ByteType(), "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(),
}


def struct(text: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session."""
    return T.StructType([T.StructField(*(f.split()[0], TYPES[f.split()[1]])) for f in text.split(",")])


EVENTS = struct(
    "txn_id string, event_time timestamp_ntz, account_id string, merchant_id string, merchant_category string, amount double,"
    " channel string, device_id string, ip string, lat double, lon double, city string, country string, status string"
)
ACCOUNTS = struct("account_id string, created_at timestamp_ntz, home_city string, home_lat double, home_lon double, spend_level double")
MERCHANTS = struct(
    "merchant_id string, name string, category string, city string, country string, lat double, lon double, is_online boolean, created_at timestamp_ntz"
)
LABELS = struct("txn_id string, is_fraud tinyint, fraud_type string, attack_id string, ring_id string, label_available_at timestamp_ntz")
SNAPSHOTS = struct(
    "snapshot_ms bigint, account_id string, graph_degree double, graph_clustering double, community_size bigint,"
    " community_shared_devices bigint, community_young_share double, ppr_risk double"
)
#: A stream message: the event and two fields more, all as strings.
MESSAGES = T.StructType([T.StructField(n, T.StringType()) for n in [*EVENTS.names, "ingest_ts", "schema_version"]])
SCORED_EXTRA = struct(
    "graph_snapshot_ms bigint, p_model double, anomaly_pct double, risk double, decision string, reasons string, account_on_hold boolean,"
    " model_version string, feature_spec_version string, ingest_ts bigint, scored_ts bigint, date date"
)


def no_labels(frame: DataFrame) -> DataFrame:
    """Refuses a frame with a label column: labels must not reach events or streams."""
    if found := LABEL_COLUMNS & set(frame.columns):
        raise ValueError(f"label columns in events: {sorted(found)}")
    return frame


def problem(columns: list[str] | None = None) -> Column:
    """What is wrong with a typed event, or null."""
    checks = {
        "txn_id": F.col("txn_id").isNull(), "event_time": F.col("event_time").isNull(), "account_id": F.col("account_id").isNull(),
        "amount": F.col("amount").isNull() | F.isnan("amount") | (F.col("amount") <= 0), "channel": ~F.coalesce(F.col("channel").isin(CHANNELS), F.lit(False)),
        "status": ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "lat": ~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)),
        "lon": ~F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), "country": ~F.coalesce(F.length("country") == 2, F.lit(False)),
        "ip": ~F.coalesce(F.col("ip").rlike(IPV4), F.lit(False)),
    }
    return F.nullif(F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in checks.items() if columns is None or name in columns]), F.lit(""))


def split_valid(events: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the others with a column `problem`."""
    checked = events.withColumn("problem", problem(columns))
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def to_message(events: DataFrame, ingest_ms: Column) -> DataFrame:
    """Typed events as messages of strings; refuses label columns."""
    no_labels(events)
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    fields = [iso.alias(c) if c == "event_time" else F.col(c).cast("string").alias(c) for c in EVENTS.names]
    return events.select(*fields, ingest_ms.cast("string").alias("ingest_ts"), F.lit(str(SCHEMA_VERSION)).alias("schema_version"))


def from_message(messages: DataFrame) -> DataFrame:
    """Messages as typed events; what cannot be cast becomes null, for split_valid to find."""
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in EVENTS]
    return messages.select(*typed, F.col("ingest_ts").try_cast("long").alias("ingest_ts"), F.col("schema_version").try_cast("int").alias("schema_version"))


def category_code(category: Column) -> Column:
    """The fixed code of a category; null where unknown."""
    levels = F.create_map(*[x for k, c in enumerate(CATEGORIES) for x in (F.lit(c), F.lit(k))])
    return F.try_element_at(levels, category)


def feature_columns(frame: DataFrame, warm: bool = True, names: list[str] | None = None) -> DataFrame:
    """The features in their order, categories as codes; a missing one or an identifier is an error."""
    wanted = names or (FEATURES if warm else HOT_FEATURES)
    if missing := [f for f in wanted if f not in frame.columns]:
        raise ValueError(f"missing features: {missing}")
    if bad := FORBIDDEN & set(wanted):
        raise ValueError(f"identifiers among the features: {sorted(bad)}")
    return frame.select(*[category_code(F.col(f)).cast("double").alias(f) if f == "merchant_category" else F.col(f).cast("double").alias(f) for f in wanted])
