"""Queries over scored rows, labels and metrics. Scores of the driver's events are arithmetic on their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DAY, HOUR
from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import joins, metrics, predicates, sets, windows
from ..sources import driver as D
from .registry import query

EXACT_RISK = "0.5 * (amount / (amount + 60.0)) + 0.5 * (((txn_id * 7919) % 1000) / 1000.0)"
RISK = f"round({EXACT_RISK}, 6)"
DECISION = "CASE WHEN risk >= 0.85 THEN 'HOLD' WHEN risk >= 0.7 THEN 'REVIEW' ELSE 'ALLOW' END"
SCORED = f"scored AS (SELECT *, {DECISION} AS decision FROM (SELECT *, {RISK} AS risk, ms + (txn_id * 31) % 250 AS scored_ts, (txn_id * 31) % 250 AS latency_ms FROM e) AS s)"
LABELLED = f"{SCORED}, labelled AS (SELECT * FROM scored JOIN lab USING (txn_id))"
# every seventh row is there twice, as after a redelivery
RAW = f"{SCORED}, raw AS (SELECT *, 0 AS copy FROM scored UNION ALL SELECT * REPLACE (scored_ts + 40 AS scored_ts), 1 AS copy FROM scored WHERE txn_id % 7 = 0)"


def scored(spark, sf_dir):
    e = D.events(spark, sf_dir).withColumns({"risk": S.rounded(F.expr(EXACT_RISK), 6), "latency_ms": F.expr("(txn_id * 31) % 250")})
    return e.withColumns({"scored_ts": F.col("ms") + F.col("latency_ms"), "decision": predicates.decide("risk", 0.7, 0.85)})


def labelled(spark, sf_dir):
    return scored(spark, sf_dir).join(D.labels(spark, sf_dir), "txn_id")


def raw(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.withColumn("copy", F.lit(0)).unionByName(s.where("txn_id % 7 = 0").withColumns({"scored_ts": F.col("scored_ts") + 40, "copy": F.lit(1)}))


def rounded(frame, places, *columns):
    kinds = dict(frame.dtypes)
    return frame.withColumns({c: S.rounded(c, places) if kinds[c] == "double" else F.round(c, places) for c in columns})


@query(D.with_ctes("SELECT txn_id, scored_ts, copy FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY scored_ts, copy) AS n FROM raw) AS x WHERE n = 1", RAW))
def deduplicated_scores(spark, sf_dir):
    return windows.earliest_copy(raw(spark, sf_dir), order=("scored_ts", "copy")).select("txn_id", "scored_ts", "copy")


@query(D.with_ctes("SELECT COUNT(DISTINCT txn_id) AS unique_rows, COUNT(*) AS raw_rows FROM raw", RAW))
def unique_and_raw(spark, sf_dir):
    return A.unique_and_raw(raw(spark, sf_dir))


@query(D.with_ctes("SELECT txn_id, risk, decision, decision <> 'ALLOW' AS alert FROM scored", SCORED))
def decisions(spark, sf_dir):
    return scored(spark, sf_dir).select("txn_id", "risk", "decision", predicates.is_alert().alias("alert"))


@query(D.with_ctes("SELECT merchant_id, COUNT(*) AS events, round(AVG(risk), 8) AS avg_risk, COUNT(*) FILTER (WHERE decision <> 'ALLOW') AS alerts FROM scored GROUP BY merchant_id ORDER BY AVG(risk) DESC, merchant_id LIMIT 10", SCORED))
def riskiest_merchants(spark, sf_dir):
    return rounded(A.riskiest_merchants(scored(spark, sf_dir)), 8, "avg_risk")


@query(D.with_ctes("SELECT ms // 3600000 * 3600000 AS hour_ms, COUNT(*) AS events, COUNT(*) FILTER (WHERE decision <> 'ALLOW') AS alerts, COUNT(*) FILTER (WHERE decision = 'HOLD') AS holds, round(AVG(CASE WHEN decision <> 'ALLOW' THEN 1.0 ELSE 0.0 END), 8) AS alert_rate FROM scored GROUP BY 1", SCORED))
def alerts_by_hour(spark, sf_dir):
    return rounded(A.by_hour(scored(spark, sf_dir)), 8, "alert_rate")


@query(D.with_ctes("SELECT quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99 FROM scored", SCORED))
def latency_percentiles(spark, sf_dir):
    return A.latency(scored(spark, sf_dir))


@query(D.with_ctes("SELECT fraud_type, COUNT(*) AS labelled, COUNT(*) FILTER (WHERE decision <> 'ALLOW') AS caught, round(COUNT(*) FILTER (WHERE decision <> 'ALLOW') / CAST(COUNT(*) AS DOUBLE), 8) AS recall FROM labelled WHERE is_fraud = 1 GROUP BY fraud_type", LABELLED))
def scorecard(spark, sf_dir):
    return rounded(A.scorecard(scored(spark, sf_dir), D.labels(spark, sf_dir)), 8, "recall")


@query(D.with_ctes("SELECT alerts, fraud, caught, round(caught / CAST(alerts AS DOUBLE), 8) AS precision, round(caught / CAST(fraud AS DOUBLE), 8) AS recall FROM (SELECT COUNT(*) FILTER (WHERE decision <> 'ALLOW') AS alerts, COUNT(*) FILTER (WHERE is_fraud = 1) AS fraud, COUNT(*) FILTER (WHERE is_fraud = 1 AND decision <> 'ALLOW') AS caught FROM labelled) AS x", LABELLED))
def scorecard_totals(spark, sf_dir):
    return rounded(A.scorecard_totals(scored(spark, sf_dir), D.labels(spark, sf_dir)), 8, "precision", "recall")


@query(D.with_ctes("SELECT merchant_id, COUNT(*) AS events, COUNT(*) FILTER (WHERE decision <> 'ALLOW') AS alerts, round(AVG(risk), 8) AS avg_risk FROM scored GROUP BY merchant_id HAVING COUNT(*) FILTER (WHERE decision <> 'ALLOW') > 0 ORDER BY alerts DESC, AVG(risk) DESC, merchant_id LIMIT 10", SCORED))
def top_merchants(spark, sf_dir):
    return rounded(A.top_merchants(scored(spark, sf_dir)), 8, "avg_risk")


@query(D.with_ctes("SELECT account_id, COUNT(*) AS events, COUNT(*) FILTER (WHERE decision <> 'ALLOW') AS alerts, MAX(risk) AS max_risk FROM scored GROUP BY account_id HAVING COUNT(*) FILTER (WHERE decision <> 'ALLOW') > 0 ORDER BY max_risk DESC, account_id LIMIT 10", SCORED))
def top_accounts(spark, sf_dir):
    return A.top_accounts(scored(spark, sf_dir))


PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(MIN({c}) AS DOUBLE) AS low, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(AVG({c}), 6) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.99), 6) AS p99, CAST(MAX({c}) AS DOUBLE) AS high, round(AVG(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM scored" for c in ("amount", "risk", "latency_ms"))


@query(D.with_ctes(PROFILE, SCORED))
def feature_profile(spark, sf_dir):
    return rounded(A.profile(scored(spark, sf_dir), ["amount", "risk", "latency_ms"]), 6, "p50", "mean", "p99", "zero_share")


@query(D.with_ctes("SELECT device_id, MIN(ms) AS first_ms, MAX(ms) AS last_ms, COUNT(*) AS events, COUNT(DISTINCT account_id) AS accounts FROM e GROUP BY device_id"))
def device_spans(spark, sf_dir):
    return A.spans(D.events(spark, sf_dir), "device_id")


@query(D.with_ctes("SELECT fraud_type, COUNT(*) AS n, round(COUNT(*) / SUM(COUNT(*)) OVER (), 8) AS share FROM lab GROUP BY fraud_type"))
def fraud_prevalence(spark, sf_dir):
    return rounded(A.prevalence(D.labels(spark, sf_dir)), 8, "share")


@query(D.with_ctes("SELECT device_id, COUNT(DISTINCT account_id) AS accounts FROM (SELECT *, MIN(ms) OVER (PARTITION BY device_id) AS first FROM e) AS x WHERE ms < first + 86400000 GROUP BY device_id"))
def first_day_reach(spark, sf_dir):
    return A.reach(D.events(spark, sf_dir), "device_id", DAY)


MEMBERS = "members AS (SELECT device_id, COUNT(DISTINCT account_id) AS members FROM e GROUP BY device_id)"


def members(spark, sf_dir):
    return D.events(spark, sf_dir).groupBy("device_id").agg(F.countDistinct("account_id").alias("members"))


@query(D.with_ctes("SELECT COUNT(members) AS n, round(AVG(members), 6) AS mean, round(quantile_cont(CAST(members AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(members AS DOUBLE), 0.9), 6) AS p90, round(quantile_cont(CAST(members AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(members AS DOUBLE), 0.99), 6) AS p99, round(quantile_cont(CAST(members AS DOUBLE), 0.999), 6) AS p99_9, MAX(members) AS high FROM members", MEMBERS))
def fanout_distribution(spark, sf_dir):
    return rounded(A.distribution(members(spark, sf_dir), "members"), 6, "mean", "p50", "p90", "p95", "p99", "p99_9")


@query(D.with_ctes("SELECT cap, COUNT(*) FILTER (WHERE members > cap) AS dropped_entities, COALESCE(SUM(members * (members - 1) / 2.0) FILTER (WHERE members > cap), 0.0) AS dropped_pairs, SUM(members * (members - 1) / 2.0) AS all_pairs FROM members, (SELECT CAST(unnest([10, 40, 60, 80]) AS INT) AS cap) AS c GROUP BY cap", MEMBERS))
def cap_table(spark, sf_dir):
    return A.cap_table(members(spark, sf_dir), [10, 40, 60, 80])


@query(D.with_ctes("SELECT feature, round(median, 6) AS median, round(greatest(CASE WHEN iqr > 0 THEN iqr ELSE sd END, 1e-12), 6) AS spread FROM (SELECT 'amount' AS feature, quantile_cont(amount, 0.5) AS median, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS iqr, stddev_pop(amount) AS sd FROM e UNION ALL SELECT 'rare', quantile_cont(CAST(CASE WHEN txn_id % 50 = 0 THEN 1 ELSE 0 END AS DOUBLE), 0.5), quantile_cont(CAST(CASE WHEN txn_id % 50 = 0 THEN 1 ELSE 0 END AS DOUBLE), 0.75) - quantile_cont(CAST(CASE WHEN txn_id % 50 = 0 THEN 1 ELSE 0 END AS DOUBLE), 0.25), stddev_pop(CASE WHEN txn_id % 50 = 0 THEN 1 ELSE 0 END) FROM e) AS x"))
def feature_spreads(spark, sf_dir):
    e = D.events(spark, sf_dir).withColumn("rare", F.expr("CASE WHEN txn_id % 50 = 0 THEN 1.0 ELSE 0.0 END").cast("double"))
    return rounded(A.spreads(e, ["amount", "rare"]), 6, "median", "spread")


@query(D.with_ctes("SELECT list_extract(list_sort(list(latency_ms)), 1 + CAST(round_even(0.95 * (COUNT(*) - 1), 0) AS BIGINT)) AS value FROM scored", SCORED))
def nearest_rank_latency(spark, sf_dir):
    return A.nearest_rank(scored(spark, sf_dir), "latency_ms", 0.95)


@query(D.with_ctes("SELECT COUNT(*) AS rows, round(COUNT(*) / ((MAX(scored_ts) - MIN(scored_ts)) / 1000.0), 8) AS rows_per_second, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99 FROM scored", SCORED))
def scoring_throughput(spark, sf_dir):
    return rounded(A.throughput(scored(spark, sf_dir)), 8, "rows_per_second")


BY_SCORE = f"{LABELLED}, by_score AS (SELECT risk, COUNT(*) AS n, SUM(is_fraud) AS h FROM labelled GROUP BY risk), cum AS (SELECT risk, n, h, SUM(n) OVER w AS a, SUM(h) OVER w AS c, (SELECT SUM(h) FROM by_score) AS p, (SELECT SUM(n) FROM by_score) AS total FROM by_score WINDOW w AS (ORDER BY risk DESC)), pts AS (SELECT risk AS threshold, CAST(a AS BIGINT) AS alerts, c / a AS precision, c / p AS recall, CASE WHEN c > 0 THEN 2 * (c / a) * (c / p) / (c / a + c / p) ELSE 0.0 END AS f1, a / total AS alert_rate FROM cum)"


@query(D.with_ctes("SELECT round(SUM(c / a * h / p), 8) AS pr_auc FROM cum", BY_SCORE))
def average_precision(spark, sf_dir):
    return rounded(metrics.pr_auc(labelled(spark, sf_dir), "risk", "is_fraud"), 8, "pr_auc")


@query(D.with_ctes("SELECT round(SUM(h * ((total - p) - (a - c) + (n - h) / 2.0)) / (MAX(p) * (MAX(total) - MAX(p))), 8) AS roc_auc FROM cum", BY_SCORE))
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(labelled(spark, sf_dir), "risk", "is_fraud"), 8, "roc_auc")


@query(D.with_ctes("SELECT threshold, alerts, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, round(alert_rate, 8) AS alert_rate FROM pts", BY_SCORE))
def threshold_points(spark, sf_dir):
    return rounded(metrics.points(labelled(spark, sf_dir), "risk", "is_fraud"), 8, "precision", "recall", "f1", "alert_rate")


@query(D.with_ctes("SELECT threshold, alerts, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, round(alert_rate, 8) AS alert_rate FROM pts WHERE alert_rate <= 0.02 AND f1 > 0 ORDER BY pts.f1 DESC, threshold DESC LIMIT 1", BY_SCORE))
def operating_point(spark, sf_dir):
    return rounded(metrics.operating_point(labelled(spark, sf_dir), "risk", "is_fraud"), 8, "precision", "recall", "f1", "alert_rate")


@query(D.with_ctes("SELECT threshold, alerts, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, round(alert_rate, 8) AS alert_rate FROM pts WHERE precision >= 0.05 AND alerts >= 50 ORDER BY threshold LIMIT 1", BY_SCORE))
def hold_threshold(spark, sf_dir):
    return rounded(metrics.hold_threshold(labelled(spark, sf_dir), "risk", "is_fraud", 0.05, 50), 8, "precision", "recall", "f1", "alert_rate")


EVALUATED = "SELECT n, fraud, alerts, caught, holds, hold_caught, round(caught / alerts, 8) AS precision, round(caught / fraud, 8) AS recall, round((alerts - caught) / (n - fraud), 8) AS fpr, round(alerts / n, 8) AS alert_rate, round(d / v, 8) AS value_detected, round(hold_caught / holds, 8) AS hold_precision, round(2 * (caught / alerts) * (caught / fraud) / (caught / alerts + caught / fraud), 8) AS f1 FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE is_fraud = 1) AS fraud, COUNT(*) FILTER (WHERE risk >= 0.7) AS alerts, COUNT(*) FILTER (WHERE risk >= 0.7 AND is_fraud = 1) AS caught, COUNT(*) FILTER (WHERE risk >= 0.85) AS holds, COUNT(*) FILTER (WHERE risk >= 0.85 AND is_fraud = 1) AS hold_caught, SUM(amount) FILTER (WHERE is_fraud = 1) AS v, SUM(amount) FILTER (WHERE is_fraud = 1 AND risk >= 0.7) AS d FROM labelled) AS x"


@query(D.with_ctes(EVALUATED, LABELLED))
def evaluation(spark, sf_dir):
    found = metrics.evaluate_at(labelled(spark, sf_dir), "risk", "is_fraud", 0.7, "amount", 0.85)
    return rounded(found, 8, "precision", "recall", "fpr", "alert_rate", "value_detected", "hold_precision", "f1")


@query(D.with_ctes("SELECT fraud_type, COUNT(*) AS fraud, COUNT(*) FILTER (WHERE risk >= 0.75) AS caught, round(COUNT(*) FILTER (WHERE risk >= 0.75) / CAST(COUNT(*) AS DOUBLE), 8) AS recall FROM labelled WHERE is_fraud = 1 GROUP BY fraud_type", LABELLED))
def recall_by_pattern(spark, sf_dir):
    return rounded(metrics.recall_by(labelled(spark, sf_dir), "risk", "is_fraud", 0.75, "fraud_type"), 8, "recall")


@query(D.with_ctes("SELECT account_id FROM lab JOIN e USING (txn_id) WHERE is_fraud = 1 AND label_ms < 1705968000000 GROUP BY account_id"))
def seed_accounts(spark, sf_dir):
    return joins.seeds(D.labels(spark, sf_dir), D.events(spark, sf_dir), 1_705_968_000_000)


@query(D.with_ctes("SELECT txn_id, EXISTS (SELECT 1 FROM scored AS h WHERE h.decision = 'HOLD' AND h.account_id = s.account_id AND h.ms < s.ms AND s.ms <= h.ms + 21600000) AS account_on_hold FROM scored AS s", SCORED))
def held_accounts(spark, sf_dir):
    s = scored(spark, sf_dir)
    return predicates.on_hold(s.select("txn_id", "account_id", "ms"), s.where("decision = 'HOLD'"), 6 * HOUR).select("txn_id", "account_on_hold")


@query(D.with_ctes("SELECT COUNT(*) FILTER (WHERE a.txn_id IS NOT NULL AND b.txn_id IS NOT NULL) AS matched, COUNT(*) FILTER (WHERE b.txn_id IS NULL) AS live_only, COUNT(*) FILTER (WHERE a.txn_id IS NULL) AS offline_only, round(MAX(abs(a.risk - b.risk)), 6) AS max_diff_risk FROM (SELECT * FROM scored WHERE txn_id % 10 <> 3) AS a FULL JOIN (SELECT * REPLACE (risk + (txn_id % 3) / 1000.0 AS risk) FROM scored WHERE txn_id % 10 <> 4) AS b USING (txn_id)", SCORED))
def live_offline_parity(spark, sf_dir):
    s = scored(spark, sf_dir)
    found = joins.parity(s.where("txn_id % 10 <> 3"), s.where("txn_id % 10 <> 4").withColumn("risk", F.col("risk") + F.col("txn_id") % 3 / 1000.0), "txn_id", ["risk"])
    return rounded(found, 6, "max_diff_risk")


@query(D.with_ctes("SELECT account_id, 'left' AS side FROM (SELECT account_id FROM scored WHERE decision = 'HOLD' EXCEPT SELECT account_id FROM scored WHERE country = 'US' AND decision <> 'ALLOW') AS a UNION ALL SELECT account_id, 'right' FROM (SELECT account_id FROM scored WHERE country = 'US' AND decision <> 'ALLOW' EXCEPT SELECT account_id FROM scored WHERE decision = 'HOLD') AS b", SCORED))
def account_differences(spark, sf_dir):
    s = scored(spark, sf_dir)
    return joins.differences(s.where("decision = 'HOLD'"), s.where("country = 'US' AND decision <> 'ALLOW'"), "account_id")


@query(D.with_ctes("SELECT txn_id, risk, decision, scored_ts FROM scored WHERE decision = 'HOLD' ORDER BY scored_ts DESC, txn_id DESC LIMIT 50", SCORED))
def recent_alerts(spark, sf_dir):
    from .serving import recent_alerts as newest

    return newest(scored(spark, sf_dir), "HOLD", 50).select("txn_id", "risk", "decision", "scored_ts")


@query(D.with_ctes("SELECT txn_id, risk, decision, account_id FROM scored WHERE txn_id = 4242", SCORED))
def transaction_lookup(spark, sf_dir):
    from .serving import transaction

    return transaction(scored(spark, sf_dir), 4242).select("txn_id", "risk", "decision", "account_id")


@query(D.with_ctes("SELECT round(quantile_cont((ms - graph_snapshot_ms) / 3600000.0, 0.5), 6) AS p50, round(quantile_cont((ms - graph_snapshot_ms) / 3600000.0, 0.95), 6) AS p95, round(MAX((ms - graph_snapshot_ms) / 3600000.0), 6) AS high FROM (SELECT ms, (SELECT MAX(t) FROM (SELECT unnest([1704153600000, 1704240000000, 1704672000000, 1705276800000]) AS t) AS c WHERE t <= ms) AS graph_snapshot_ms FROM e) AS x WHERE graph_snapshot_ms IS NOT NULL"))
def snapshot_staleness(spark, sf_dir):
    days = [1_704_153_600_000, 1_704_240_000_000, 1_704_672_000_000, 1_705_276_800_000]
    placed = D.events(spark, sf_dir).withColumn("graph_snapshot_ms", joins.latest_at(F.col("ms"), days))
    return rounded(A.staleness(placed), 6, "p50", "p95", "high")


@query(D.with_ctes("SELECT decision, COUNT(*) AS n FROM scored GROUP BY decision", SCORED))
def decision_counts(spark, sf_dir):
    return A.group_counts(scored(spark, sf_dir), "decision")


@query(D.with_ctes("SELECT DISTINCT round(threshold, 12) AS threshold FROM (SELECT unnest(quantile_cont(risk, [" + ", ".join(str(k / 16) for k in range(17)) + "])) AS threshold FROM (SELECT DISTINCT risk FROM scored) AS r) AS t", SCORED))
def candidate_thresholds(spark, sf_dir):
    return rounded(metrics.candidate_thresholds(scored(spark, sf_dir), "risk", 17), 12, "threshold")


@query(D.with_ctes("SELECT ms, txn_id, account_id, NULL AS note, 'past' AS part FROM e WHERE ms < 1705276800000 UNION ALL SELECT ms, txn_id, account_id, 'live', 'live' FROM e WHERE ms >= 1705276800000 AND ms < 1705968000000"))
def history_and_live(spark, sf_dir):
    """History before a boundary and live events with one column more, up to a snapshot."""
    from ..sources.tables import graph_input, history

    e = D.events(spark, sf_dir).select("ms", "txn_id", "account_id")
    live = e.where("ms >= 1705276800000").withColumns({"part": F.lit("live"), "note": F.lit("live")})
    return graph_input(history(e, 1_705_276_800_000).withColumn("part", F.lit("past")), live, 1_705_968_000_000)


@query(D.with_ctes("SELECT txn_id, ms, ip FROM e WHERE merchant_category IN ('travel', 'fuel') AND amount BETWEEN 20 AND 40 UNION ALL SELECT txn_id, ms, ip FROM e WHERE status = 'DECLINED' AND amount > 200"))
def filters_and_union(spark, sf_dir):
    e = D.events(spark, sf_dir)
    return sets.united(e.where("merchant_category IN ('travel', 'fuel') AND amount BETWEEN 20 AND 40").select("txn_id", "ms", "ip"), e.where("status = 'DECLINED' AND amount > 200").select("txn_id", "ms", "ip"))


@query(D.with_ctes("SELECT DISTINCT e.account_id, e.device_id FROM e WHERE device_id IN (SELECT device_id FROM e WHERE status = 'DECLINED' GROUP BY device_id HAVING COUNT(*) BETWEEN 5 AND 20)"))
def membership_semi_join(spark, sf_dir):
    e = D.events(spark, sf_dir)
    fit = e.where("status = 'DECLINED'").groupBy("device_id").count().where("count BETWEEN 5 AND 20")
    return e.join(fit, "device_id", "left_semi").select("account_id", "device_id").distinct()


@query("SELECT n_name, o_orderpriority, COUNT(*) AS orders, round(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def orders_by_nation(spark, sf_dir):
    """A star join: the small dimension is left to the optimiser's own size check."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    o = read("orders", "o_custkey", "o_orderpriority", "o_totalprice").join(read("customer", F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return o.join(read("nation", F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS sum_qty, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
