"""The driver's tables as the engine's: events become card transactions by arithmetic on their columns.

The same arithmetic stands here twice, as columns and as SQL, so that each operator can be held against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import millis

EVENT_EXPRESSIONS = {
    "txn_id": "event_id", "account_id": "user_id", "amount": "value", "merchant_id": "event_id % 97", "ip": "(event_id * 7) % 211",
    "merchant_category": "CASE event_type WHEN 'view' THEN 'grocery' WHEN 'click' THEN 'ecommerce' WHEN 'purchase' THEN 'travel' WHEN 'signup' THEN 'digital_goods' ELSE 'fuel' END",
    "channel": "CASE WHEN event_type IN ('view', 'click') THEN 'ONLINE' ELSE 'POS' END",
    "status": "CASE WHEN event_type = 'error' THEN 'DECLINED' ELSE 'APPROVED' END",
    "country": "CASE WHEN device_id % 10 = 0 THEN 'US' ELSE 'IN' END",
    "lat": "8.0 + ((device_id * 37) % 290) / 10.0", "lon": "70.0 + ((device_id * 53) % 250) / 10.0", "city": "concat('C', CAST(device_id % 20 AS STRING))",
}
ACCOUNT_EXPRESSIONS = {
    "created_ms": "1685577600000 + ((account_id * 7919) % 300) * 86400000", "home_city": "concat('C', CAST(account_id % 20 AS STRING))",
    "home_lat": "8.0 + ((account_id * 37) % 290) / 10.0", "home_lon": "70.0 + ((account_id * 53) % 250) / 10.0",
}
LABEL_EXPRESSIONS = {
    "is_fraud": "CASE WHEN status = 'DECLINED' AND amount > 100 THEN 1 ELSE 0 END",
    "fraud_type": "CASE WHEN NOT (status = 'DECLINED' AND amount > 100) THEN 'NONE' WHEN txn_id % 4 = 0 THEN 'VELOCITY' WHEN txn_id % 4 = 1 THEN 'ATO' WHEN txn_id % 4 = 2 THEN 'CARD_TESTING' ELSE 'RING' END",
    "label_ms": "ms + 1209600000",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with event time in milliseconds."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    based = raw.select("*", millis("ts").alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("device_id"))
    return based.select(F.col("ts").alias("event_time"), "ms", "device_id", *[F.expr(e).alias(c) for c, e in EVENT_EXPRESSIONS.items()])


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account directory; each fifth account is not in it."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("account_id")).distinct().where("account_id % 5 <> 4")
    return ids.select("account_id", *[F.expr(e).alias(c) for c, e in ACCOUNT_EXPRESSIONS.items()])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("txn_id", *[F.expr(e).alias(c) for c, e in LABEL_EXPRESSIONS.items()])


def sql(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR")


def columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{sql(e)} AS {c}" for c, e in expressions.items())


#: The same tables as common table expressions of the other engine: e, acct and lab.
CTES = f"""
base AS (SELECT *, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS device_id FROM events),
e AS (SELECT ts AS event_time, ms, device_id, {columns(EVENT_EXPRESSIONS)} FROM base),
acct AS (SELECT account_id, {columns(ACCOUNT_EXPRESSIONS)} FROM (SELECT DISTINCT user_id AS account_id FROM events) AS u WHERE account_id % 5 <> 4),
lab AS (SELECT txn_id, {columns(LABEL_EXPRESSIONS)} FROM e)
"""


def with_ctes(query: str, more: str = "") -> str:
    return f"WITH {CTES}{', ' + more if more else ''} {query}"
