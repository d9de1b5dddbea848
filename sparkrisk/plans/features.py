"""Queries over the behavioural features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DAY, HOUR, RuleConfig
from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import fanout, joins, predicates, sets, windows
from ..sources import driver as D
from .registry import query

#: Thresholds at which the driver's sparse events make rules fire.
RULES = RuleConfig(r1_cnt_5m=1, r2_speed=50.0, r3_dev_accts_1h=1, r3_small_1h=1, r3_declines_1h=1, r4_dev_accts_30d=20, r4_age_days=400.0)

RANGE = "PARTITION BY account_id ORDER BY ms RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING"
PRIOR = "PARTITION BY account_id ORDER BY ms, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
M5, H1, D1 = (RANGE.format(w=w) for w in (300_000, HOUR, DAY))
VELOCITY = f"""
  COUNT(*) OVER ({M5}) AS acct_cnt_5m, COUNT(*) OVER ({H1}) AS acct_cnt_1h, COUNT(*) OVER ({D1}) AS acct_cnt_24h,
  round(COALESCE(SUM(amount) OVER ({D1}), 0), 4) AS acct_amt_24h, CAST(COUNT(DISTINCT merchant_id) OVER ({H1}) AS INT) AS acct_merchants_1h,
  CAST(COALESCE(SUM(CASE WHEN status = 'DECLINED' THEN 1 ELSE 0 END) OVER ({H1}), 0) AS BIGINT) AS acct_declines_1h,
  CAST(COALESCE(SUM(CASE WHEN amount < 100 THEN 1 ELSE 0 END) OVER ({H1}), 0) AS BIGINT) AS acct_small_1h"""
ALL = "COALESCE(SUM(CASE WHEN status = 'APPROVED' THEN {x} END) OVER (" + PRIOR + "), 0)"
SUMS = f"""sums AS (SELECT *, CAST({ALL.format(x='1.0')} AS DOUBLE) AS n_ok, {ALL.format(x='amount')} AS s_ok, {ALL.format(x='amount * amount')} AS ss_ok,
  COUNT(*) OVER ({PRIOR}) AS n_all, LAG(ms) OVER (PARTITION BY account_id ORDER BY ms, txn_id) AS last_ms,
  LAG(lat) OVER (PARTITION BY account_id ORDER BY ms, txn_id) AS last_lat, LAG(lon) OVER (PARTITION BY account_id ORDER BY ms, txn_id) AS last_lon,
  LAG(ms) OVER (PARTITION BY account_id, device_id ORDER BY ms, txn_id) AS device_ms,
  ROW_NUMBER() OVER (PARTITION BY account_id, merchant_id ORDER BY ms, txn_id) AS merchant_n, ROW_NUMBER() OVER (PARTITION BY account_id, city ORDER BY ms, txn_id) AS city_n,
  (ms // 3600000) % 24 AS h FROM e),
buckets AS (SELECT *, COUNT(*) OVER (PARTITION BY account_id, h // 4 ORDER BY ms, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_bucket,
  CASE WHEN n_ok >= 2 THEN sqrt(greatest((ss_ok - s_ok * s_ok / n_ok) / (n_ok - 1), 0)) ELSE 0 END AS sd FROM sums),
facts AS (SELECT b.*, a.created_ms, a.home_city, a.home_lat, a.home_lon FROM buckets AS b LEFT JOIN acct AS a USING (account_id))"""
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, power(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin((radians({d}) - radians({c})) / 2), 2)))))"
HOME, MOVE = HAVERSINE.format(a="home_lat", b="lat", c="home_lon", d="lon"), HAVERSINE.format(a="last_lat", b="lat", c="last_lon", d="lon")
CONTEXT = "round(ln(1 + amount), 6) AS log_amount, CAST(h AS INT) AS hour_of_day, CASE WHEN h < 5 THEN 1 ELSE 0 END AS is_night, CASE WHEN channel = 'ONLINE' THEN 1 ELSE 0 END AS is_online, CASE WHEN country <> 'IN' THEN 1 ELSE 0 END AS is_international"
DEVIATION = """round(CASE WHEN last_ms IS NULL THEN 2592000.0 ELSE least((ms - last_ms) / 1000.0, 2592000.0) END, 3) AS secs_since_last,
  round(CASE WHEN n_ok >= 3 THEN greatest(-10.0, least(50.0, (amount - s_ok / n_ok) / greatest(sd, 0.25 * s_ok / n_ok, 50.0))) ELSE 0.0 END, 10) AS amount_zscore,
  round(CASE WHEN n_ok > 0 AND s_ok / n_ok > 0 THEN least(amount / (s_ok / n_ok), 100.0) ELSE 1.0 END, 10) AS amount_to_mean,
  round(1.0 - CAST(n_bucket + 1 AS DOUBLE) / (n_all + 6), 6) AS hour_unusualness, n_all AS acct_history_cnt"""
NOVELTY = f"""round(COALESCE((ms - created_ms) / 86400000.0, 0.0), 6) AS account_age_days, CASE WHEN device_ms IS NULL OR device_ms < last_ms - 7776000000 THEN 1 ELSE 0 END AS new_device,
  CASE WHEN merchant_n = 1 THEN 1 ELSE 0 END AS new_merchant, CASE WHEN city_n = 1 AND NOT COALESCE(city = home_city, FALSE) THEN 1 ELSE 0 END AS new_city,
  round(COALESCE({HOME}, 0.0), 4) AS km_from_home, round(CASE WHEN last_ms IS NULL THEN 0.0 ELSE least(({MOVE}) / (greatest((ms - last_ms) / 1000.0, 60.0) / 3600.0), 5000.0) END, 3) AS geo_speed_kmh"""


def last_use(name: str, entity: str, member: str, width: int) -> str:
    return f"""{name} AS (SELECT id, CAST(SUM(CASE WHEN last_ms >= t - {width} AND last_ms < t THEN 1 ELSE 0 END) AS BIGINT) AS {name} FROM (
  SELECT a.txn_id AS id, a.ms AS t, b.{member} AS m, MAX(b.ms) AS last_ms FROM e AS a LEFT JOIN e AS b ON a.{entity} = b.{entity} AND (b.ms < a.ms OR (b.ms = a.ms AND b.txn_id < a.txn_id)) GROUP BY a.txn_id, a.ms, b.{member}) AS x GROUP BY id)"""


COUNTS = [
    fanout.Count("dev_accts_1h", "device_id", "account_id", HOUR), fanout.Count("dev_accts_30d", "device_id", "account_id", 30 * DAY), fanout.Count("ip_accts_1h", "ip", "account_id", HOUR),
    fanout.Count("ip_accts_30d", "ip", "account_id", 30 * DAY), fanout.Count("mer_accts_30d", "merchant_id", "account_id", 30 * DAY), fanout.Count("acct_devices_30d", "account_id", "device_id", 30 * DAY),
]
FANOUT = ", ".join(last_use(c.name, c.entity, c.member, c.width) for c in COUNTS)
FANOUT_JOINS = " ".join(f"JOIN {c.name} ON {c.name}.id = f.txn_id" for c in COUNTS)
FANOUT_COLUMNS = ", ".join(f"COALESCE({c.name}.{c.name}, 0) AS {c.name}" for c in COUNTS)
#: Places of the compared columns; ratios get so many that no exact half occurs, which engines round differently.
ROUNDED = {"log_amount": 6, "acct_amt_24h": 4, "secs_since_last": 3, "amount_zscore": 10, "amount_to_mean": 10, "hour_unusualness": 6, "account_age_days": 6, "km_from_home": 4, "geo_speed_kmh": 3}


def rounded(frame, *columns):
    return frame.select(*[F.round(c, ROUNDED[c]).alias(c) if c in ROUNDED else F.col(c) for c in columns])


@query(D.with_ctes(f"SELECT txn_id, account_id, ms, {VELOCITY}, CASE WHEN COUNT(*) OVER ({M5}) >= 1 THEN 1 ELSE 0 END AS r1_velocity FROM e"))
def velocity_rules(spark, sf_dir):
    """Flagship: how much an account did before each event, and whether the velocity rule fires."""
    v = windows.velocity()
    out = D.events(spark, sf_dir).select("txn_id", "account_id", "ms", *[c.alias(n) for n, c in v.items()])
    return rounded(out.withColumn("r1_velocity", (F.col("acct_cnt_5m") >= RULES.r1_cnt_5m).cast("int")), "txn_id", "account_id", "ms", *v, "r1_velocity")


@query(D.with_ctes(f"SELECT txn_id, {CONTEXT}, merchant_category FROM sums", SUMS.split("buckets AS")[0].rstrip().rstrip(",")))
def context_features(spark, sf_dir):
    return rounded(D.events(spark, sf_dir).select("txn_id", "merchant_category", *[c.alias(n) for n, c in windows.context().items()]), "txn_id", *windows.context(), "merchant_category")


@query(D.with_ctes(f"SELECT txn_id, {DEVIATION} FROM facts", SUMS))
def deviation_features(spark, sf_dir):
    return rounded(D.events(spark, sf_dir).select("txn_id", *[c.alias(n) for n, c in windows.deviation().items()]), "txn_id", *windows.deviation())


@query(D.with_ctes(f"SELECT txn_id, {NOVELTY} FROM facts", SUMS))
def novelty_features(spark, sf_dir):
    names = ["txn_id", "account_age_days", "new_device", "new_merchant", "new_city", "km_from_home", "geo_speed_kmh"]
    return rounded(windows.account_features(D.events(spark, sf_dir), D.accounts(spark, sf_dir)), *names)


@query(D.with_ctes(f"SELECT f.txn_id, {FANOUT_COLUMNS} FROM e AS f {FANOUT_JOINS}", FANOUT))
def fanout_features(spark, sf_dir):
    return fanout.last_use_counts(D.events(spark, sf_dir), COUNTS)


HOT = f"""hot AS (SELECT f.txn_id, f.account_id, f.ms, f.amount, f.status, {CONTEXT}, f.merchant_category, {VELOCITY}, {DEVIATION}, {NOVELTY}, {FANOUT_COLUMNS} FROM facts AS f {FANOUT_JOINS})"""
HOT_CTES = f"{SUMS}, {FANOUT}, {HOT}"


def hot(spark, sf_dir):
    return windows.hot_features(D.events(spark, sf_dir), D.accounts(spark, sf_dir))


@query(D.with_ctes("SELECT * EXCLUDE (account_id, ms, amount, status) FROM hot", HOT_CTES))
def hot_features(spark, sf_dir):
    """All 30 features of every event."""
    from ..schemas import HOT_FEATURES

    return rounded(hot(spark, sf_dir), "txn_id", *HOT_FEATURES)


RULE_SQL = """CASE WHEN acct_cnt_5m >= 1 THEN 1 ELSE 0 END AS r1_velocity, CASE WHEN geo_speed_kmh >= 50 AND new_device = 1 THEN 1 ELSE 0 END AS r2_ato,
  CASE WHEN dev_accts_1h >= 1 OR (acct_small_1h >= 1 AND acct_declines_1h >= 1) THEN 1 ELSE 0 END AS r3_card_testing, CASE WHEN dev_accts_30d >= 20 AND account_age_days < 400 THEN 1 ELSE 0 END AS r4_ring"""
RULED = f"{HOT_CTES}, ruled AS (SELECT *, r1_velocity + r2_ato + r3_card_testing + r4_ring AS k FROM (SELECT *, {RULE_SQL} FROM hot) AS r)"


@query(D.with_ctes("SELECT txn_id, r1_velocity, r2_ato, r3_card_testing, r4_ring, k > 0 AS rule_flag, CAST(k AS DOUBLE) AS rule_score FROM ruled", RULED))
def rule_outcomes(spark, sf_dir):
    return predicates.apply_rules(hot(spark, sf_dir), RULES).select("txn_id", "r1_velocity", "r2_ato", "r3_card_testing", "r4_ring", "rule_flag", "rule_score")


@query(D.with_ctes("SELECT round(AVG(r1_velocity), 8) AS r1_velocity, round(AVG(r2_ato), 8) AS r2_ato, round(AVG(r3_card_testing), 8) AS r3_card_testing, round(AVG(r4_ring), 8) AS r4_ring FROM ruled", RULED))
def rule_firing_rates(spark, sf_dir):
    rates = predicates.firing_rates(predicates.apply_rules(hot(spark, sf_dir), RULES))
    return rates.select(*[F.round(c, 8).alias(c) for c in rates.columns])


@query(D.with_ctes("SELECT txn_id, ms, account_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id, ms // 86400000 ORDER BY ms, txn_id) AS n FROM e) AS x WHERE n = 1"))
def first_of_day(spark, sf_dir):
    return windows.first_of_day(D.events(spark, sf_dir)).select("txn_id", "ms", "account_id")


@query(D.with_ctes("SELECT DISTINCT account_id FROM (SELECT account_id, ms - LAG(ms, 2) OVER (PARTITION BY account_id ORDER BY ms, txn_id) AS span FROM e WHERE amount < 100) AS x WHERE span <= 21600000"))
def burst_accounts(spark, sf_dir):
    return windows.bursts(D.events(spark, sf_dir), 3, 6 * HOUR, 100.0)


@query(D.with_ctes("SELECT device_id, boundary_ms, COUNT(DISTINCT account_id) AS members FROM e JOIN (SELECT DISTINCT (ms // 86400000 + k) * 86400000 AS boundary_ms FROM e, (SELECT unnest(range(1, 5)) AS k) AS ks) AS c ON ms < boundary_ms AND ms >= boundary_ms - 259200000 GROUP BY ALL"))
def daily_fanout(spark, sf_dir):
    return windows.daily_fanout(D.events(spark, sf_dir), "device_id", 3 * DAY)


@query(D.with_ctes("SELECT device_id, account_id, start_ms, MIN(start_ms) OVER (PARTITION BY device_id) < start_ms AS reused FROM (SELECT device_id, account_id, MIN(ms) AS start_ms FROM e GROUP BY ALL) AS u"))
def device_reuse(spark, sf_dir):
    uses = D.events(spark, sf_dir).groupBy("device_id", "account_id").agg(F.min("ms").alias("start_ms"))
    return windows.earlier_groups(uses, "device_id", "account_id", "start_ms")


@query(D.with_ctes("SELECT txn_id, account_id, merchant_id, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY txn_id) - 1 AS INT) AS slot FROM e"))
def merchant_slots(spark, sf_dir):
    return windows.slots(D.events(spark, sf_dir).select("txn_id", "account_id", "merchant_id"), "merchant_id", "txn_id")


@query(D.with_ctes("SELECT account_id, txn_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ms, txn_id) AS k FROM (SELECT *, SUM(amount) OVER (PARTITION BY account_id ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) / SUM(amount) OVER (PARTITION BY account_id) AS part FROM e) AS x WHERE part > (account_id % 10) / 10.0 + 0.05) AS y WHERE k = 1"))
def weighted_picks(spark, sf_dir):
    options = D.events(spark, sf_dir).withColumns({"order": F.struct("ms", "txn_id"), "u": F.col("account_id") % 10 / 10.0 + 0.05})
    return windows.weighted_pick(options, "account_id", "amount", "order", "u").select("account_id", "txn_id", "amount")


@query(D.with_ctes("SELECT txn_id, a.account_id, ms, COALESCE(anchor_ms, -1) AS anchor_ms, COALESCE(anchor_merchant_id, -1) AS anchor_merchant_id FROM (SELECT *, MAX(CASE WHEN channel = 'POS' AND status = 'APPROVED' THEN ms END) OVER w AS anchor_ms, arg_max(CASE WHEN channel = 'POS' AND status = 'APPROVED' THEN merchant_id END, CASE WHEN channel = 'POS' AND status = 'APPROVED' THEN ms END) OVER w AS anchor_merchant_id FROM e WINDOW w AS (PARTITION BY account_id ORDER BY ms, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS a WHERE status = 'DECLINED'"))
def previous_honest_event(spark, sf_dir):
    """Declined events with the account's last approved one at a terminal."""
    c = F.col
    found = joins.previous_by_kind(D.events(spark, sf_dir), "account_id", c("status") == "DECLINED", (c("channel") == "POS") & (c("status") == "APPROVED"), ["ms", "merchant_id"])
    return found.select("txn_id", "account_id", "ms", "anchor_ms", "anchor_merchant_id").fillna(-1)


@query(D.with_ctes("SELECT a.txn_id, a.account_id, a.ms, COALESCE(b.ms, -1) AS ms_asof, COALESCE(b.amount, -1.0) AS purchase FROM (SELECT * FROM e WHERE status = 'DECLINED') AS a ASOF LEFT JOIN (SELECT account_id, ms, amount FROM e WHERE merchant_category = 'travel') AS b ON a.account_id = b.account_id AND a.ms >= b.ms"))
def asof_last_purchase(spark, sf_dir):
    e = D.events(spark, sf_dir)
    bought = e.where("merchant_category = 'travel'").select("account_id", "ms", F.col("amount").alias("purchase"))
    return joins.asof_by_key(e.where("status = 'DECLINED'").select("txn_id", "account_id", "ms"), bought, "account_id", "ms", "ms", ["purchase"]).fillna(-1)


@query(D.with_ctes("SELECT txn_id, split, CAST(CASE WHEN ms >= 1704067200000 AND ms < 1704326400000 THEN 1 ELSE 0 END AS TINYINT) AS in_burn_in FROM (SELECT txn_id, ms, CASE WHEN ms >= 1704067200000 AND ms < 1705276800000 THEN 'train' WHEN ms >= 1705276800000 AND ms < 1705708800000 THEN 'early_stop' WHEN ms >= 1705708800000 AND ms < 1706140800000 THEN 'valid' WHEN ms >= 1706140800000 AND ms < 1706486400000 THEN 'test' ELSE 'none' END AS split FROM e) AS s"))
def split_tags(spark, sf_dir):
    return predicates.tag_splits(D.events(spark, sf_dir), cfg=DRIVER_SPLITS).select("txn_id", "split", "in_burn_in")


from ..config import SplitConfig  # noqa: E402

DRIVER_SPLITS = SplitConfig(
    splits=(("train", "2024-01-01", "2024-01-15"), ("early_stop", "2024-01-15", "2024-01-20"), ("valid", "2024-01-20", "2024-01-25"), ("test", "2024-01-25", "2024-01-29")),
    burn_in=("2024-01-01", "2024-01-04"),
)


@query(D.with_ctes("SELECT split, COUNT(*) AS n FROM (SELECT CASE WHEN ms >= 1704326400000 AND ms < 1705276800000 THEN 'train' WHEN ms >= 1705276800000 AND ms < 1705708800000 THEN 'early_stop' WHEN ms >= 1705708800000 AND ms < 1706140800000 THEN 'valid' END AS split FROM e) AS s WHERE split IS NOT NULL GROUP BY split"))
def split_rows(spark, sf_dir):
    tagged = predicates.tag_splits(D.events(spark, sf_dir), cfg=DRIVER_SPLITS)
    parts = [predicates.select_split(tagged, s, DRIVER_SPLITS) for s in ("train", "early_stop", "valid")]
    return A.group_counts(sets.united(*parts), "split")


@query(D.with_ctes("SELECT ms, account_id, txn_id, position, position // 500 AS batch FROM (SELECT *, row_number() OVER (ORDER BY ms, txn_id) - 1 AS position FROM e) AS x"))
def replay_batches(spark, sf_dir):
    """The stream in total order, cut into batches."""
    return sets.batches(D.events(spark, sf_dir).select("ms", "account_id", "txn_id"), 500, "ms", "txn_id")


@query(D.with_ctes("SELECT txn_id, ms FROM e WHERE ms >= 1704672000000 AND ms < 1705276800000 ORDER BY ms, txn_id LIMIT 500"))
def replay_window(spark, sf_dir):
    """The first 500 events of a replay that starts inside its window: the limit is the operator's own."""
    return sets.replay_window(D.events(spark, sf_dir), 1_704_067_200_000, 1_705_276_800_000, start_at=1_704_672_000_000, limit=500).select("txn_id", "ms")


@query(D.with_ctes("SELECT CAST(SUM(CASE WHEN ms < before OR (ms = before AND txn_id < before_id) THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT ms, txn_id, LAG(ms) OVER (ORDER BY (txn_id * 7919) % 1000003) AS before, LAG(txn_id) OVER (ORDER BY (txn_id * 7919) % 1000003) AS before_id FROM e) AS x"))
def order_violations(spark, sf_dir):
    shuffled = D.events(spark, sf_dir).withColumn("position", F.col("txn_id") * 7919 % 1_000_003)
    return predicates.order_violations(shuffled, "ms", "txn_id")


@query(D.with_ctes("SELECT txn_id, round(6371.0 * 2 * asin(sqrt(least(1.0, greatest(0.0, power(sin(radians(lat - 20) / 2), 2) + cos(radians(20)) * cos(radians(lat)) * power(sin(radians(lon - 77) / 2), 2))))), 3) AS km, round(1 / (1 + exp(-(amount - 50) / 25)), 8) AS p, greatest(least(amount, 80.0), 20.0) AS clipped, (ms // 3600000) % 24 AS hour, 'T' || lpad(CAST(txn_id AS VARCHAR), 7, '0') AS name, ms // 1000 AS s, sha256(CAST(txn_id AS VARCHAR)) AS digest, round(0.7 * amount + 0.3 * lat, 6) AS mixed, 'Paid ' || CAST(CAST(round_even(amount, 0) AS BIGINT) AS VARCHAR) || ' in all' AS said, CASE WHEN amount < 10 THEN 'live' WHEN amount < 60 THEN 'late' ELSE 'down' END AS beat FROM e"))
def scalar_functions(spark, sf_dir):
    e = D.events(spark, sf_dir)
    return e.select(
        "txn_id", F.round(S.haversine_km(F.lit(20.0), F.lit(77.0), F.col("lat"), F.col("lon")), 3).alias("km"), F.round(S.logistic((F.col("amount") - 50) / 25), 8).alias("p"), S.clip("amount", 20.0, 80.0).alias("clipped"),
        S.hour_of("ms").cast("long").alias("hour"), S.padded_id("T", "txn_id").alias("name"), S.seconds("event_time").alias("s"), S.sha256("txn_id").alias("digest"), F.round(S.blend("amount", "lat", 0.7), 6).alias("mixed"), S.template("Paid {value:.0f} in all", "amount").alias("said"), S.heartbeat("amount").alias("beat"),
    )
