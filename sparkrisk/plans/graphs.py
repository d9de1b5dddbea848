"""Queries over the account graph of the driver's events: daily snapshots with a lookback of one day."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DAY, GRAPH
from ..operators import graph as G
from ..operators import joins
from ..operators.tables import kept
from ..sources import driver as D
from .registry import query

#: One key reaches most accounts within a month here, so the lookback is a day.
CFG = replace(GRAPH, lookback=DAY)
#: A snapshot at the end of each day that has begun after the first event's day, up to the last event: all of the table's days but a last broken one.
CAL = f"""span AS (SELECT (MIN(ms) // {DAY} + 1) * {DAY} AS low, MAX(ms) // {DAY} * {DAY} AS high FROM e),
cal AS (SELECT unnest(range(low, greatest(low, high) + 1, {DAY})) AS snapshot_ms FROM span)"""
MEMBERS = f"""{CAL}, placed AS (SELECT snapshot_ms, account_id, device_id, ip FROM e, cal WHERE ms < snapshot_ms AND ms >= snapshot_ms - {DAY}),
uses AS (SELECT DISTINCT snapshot_ms, 'device_id' AS kind, CAST(device_id AS VARCHAR) AS entity, account_id, 16 AS cap FROM placed UNION ALL SELECT DISTINCT snapshot_ms, 'ip', CAST(ip AS VARCHAR), account_id, 18 FROM placed),
members AS (SELECT snapshot_ms, kind, entity, account_id FROM uses JOIN (SELECT snapshot_ms, kind, entity, cap FROM uses GROUP BY ALL HAVING COUNT(*) BETWEEN 2 AND MIN(cap)) AS fit USING (snapshot_ms, kind, entity))"""
EDGES = f"""{MEMBERS}, links AS (SELECT a.snapshot_ms, a.account_id AS u, b.account_id AS v, COUNT(*) AS weight FROM members AS a JOIN members AS b ON a.snapshot_ms = b.snapshot_ms AND a.kind = b.kind AND a.entity = b.entity AND a.account_id < b.account_id GROUP BY ALL),
sym AS (SELECT snapshot_ms, u, v, weight FROM links UNION ALL SELECT snapshot_ms, v, u, weight FROM links)"""


def whole_span(spark, sf_dir):
    """First and last snapshot of the table: the days' ends after its first event, up to its last one. Without events there is none."""
    low, high = D.events(spark, sf_dir).agg(F.min("ms"), F.max("ms")).first()
    if low is None:
        return DAY, 0
    first = (low // DAY + 1) * DAY
    return first, max(first, high // DAY * DAY)


def snapshots(spark, sf_dir):
    return G.calendar(spark, *whole_span(spark, sf_dir), CFG)


def days_of(spark, sf_dir):
    first, last = whole_span(spark, sf_dir)
    return list(range(first, last + 1, DAY))


def placed(spark, sf_dir):
    return G.in_lookback(D.events(spark, sf_dir), snapshots(spark, sf_dir), CFG)


def members(spark, sf_dir):
    return G.memberships(placed(spark, sf_dir), CFG)


def links(spark, sf_dir):
    return G.edges(members(spark, sf_dir))


@query(D.with_ctes("SELECT * FROM cal", CAL))
def snapshot_calendar(spark, sf_dir):
    return snapshots(spark, sf_dir)


@query(D.with_ctes("SELECT * FROM members", MEMBERS))
def entity_memberships(spark, sf_dir):
    return members(spark, sf_dir)


@query(D.with_ctes("SELECT snapshot_ms, entity, COUNT(*) AS accounts FROM members WHERE kind = 'device_id' GROUP BY ALL", MEMBERS))
def capped_devices(spark, sf_dir):
    return G.capped_entities(placed(spark, sf_dir), "device_id", CFG)


@query(D.with_ctes("SELECT * FROM links", EDGES))
def account_edges(spark, sf_dir):
    return links(spark, sf_dir)


@query(D.with_ctes("SELECT snapshot_ms, u AS account_id, CAST(SUM(weight) AS DOUBLE) AS graph_degree FROM sym GROUP BY ALL", EDGES))
def weighted_degree(spark, sf_dir):
    return G.degrees(links(spark, sf_dir))


@query(D.with_ctes("SELECT snapshot_ms, account_id, round(CASE WHEN d > 1 THEN COALESCE(t, 0) / (d * (d - 1.0)) ELSE 0.0 END, 8) AS graph_clustering FROM (SELECT snapshot_ms, u AS account_id, COUNT(*) AS d FROM sym GROUP BY ALL) AS deg LEFT JOIN (SELECT a.snapshot_ms, a.u AS account_id, COUNT(*) AS t FROM sym AS a JOIN sym AS b ON a.snapshot_ms = b.snapshot_ms AND a.u = b.u AND a.v <> b.v JOIN sym AS c ON c.snapshot_ms = a.snapshot_ms AND c.u = a.v AND c.v = b.v GROUP BY ALL) AS tri USING (snapshot_ms, account_id)", EDGES))
def clustering_coefficient(spark, sf_dir):
    return G.clustering(kept(links(spark, sf_dir))).withColumn("graph_clustering", F.round("graph_clustering", 8))


REACH = f"""RECURSIVE {D.CTES.strip()}, {EDGES}, reach AS (SELECT DISTINCT snapshot_ms, u AS a, u AS b FROM sym UNION SELECT r.snapshot_ms, r.a, s.v FROM reach AS r JOIN sym AS s ON s.snapshot_ms = r.snapshot_ms AND s.u = r.b)"""


@query(f"WITH {REACH} SELECT snapshot_ms, a AS account_id, MIN(b) AS component FROM reach GROUP BY ALL")
def connected_components(spark, sf_dir):
    return G.connected(kept(links(spark, sf_dir)))


GROUPS = "groups AS (SELECT snapshot_ms, a AS account_id, MIN(b) AS community FROM reach GROUP BY ALL)"


@query(f"""WITH {REACH}, {GROUPS},
shared AS (SELECT snapshot_ms, community, COUNT(*) AS n FROM (SELECT snapshot_ms, community, entity FROM members JOIN groups USING (snapshot_ms, account_id) WHERE kind = 'device_id' GROUP BY ALL HAVING COUNT(*) >= 2) AS x GROUP BY ALL),
sizes AS (SELECT snapshot_ms, community, COUNT(*) AS community_size, COALESCE(AVG(CASE WHEN created_ms IS NULL THEN NULL WHEN created_ms > snapshot_ms - 12960000000 THEN 1.0 ELSE 0.0 END), 0.0) AS young FROM groups LEFT JOIN acct USING (account_id) GROUP BY ALL)
SELECT snapshot_ms, account_id, community_size, COALESCE(n, 0) AS community_shared_devices, round(young, 8) AS community_young_share FROM groups JOIN sizes USING (snapshot_ms, community) LEFT JOIN shared USING (snapshot_ms, community)""")
def community_facts(spark, sf_dir):
    """Community features, with the connected components as the communities."""
    m = kept(members(spark, sf_dir))
    groups = G.connected(kept(G.edges(m))).withColumnRenamed("component", "community")
    out = G.community_features(groups, m, D.accounts(spark, sf_dir), replace(CFG, young=150 * DAY))
    return out.select("snapshot_ms", "account_id", "community_size", "community_shared_devices", F.round("community_young_share", 8).alias("community_young_share"))


@query(D.with_ctes("SELECT DISTINCT snapshot_ms, account_id FROM cal JOIN lab ON label_ms < snapshot_ms AND is_fraud = 1 JOIN e USING (txn_id)", CAL))
def snapshot_seeds(spark, sf_dir):
    """Fraud that is known at each snapshot; labels come 14 days after the event."""
    return G.seed_accounts(D.labels(spark, sf_dir), D.events(spark, sf_dir), snapshots(spark, sf_dir))


@query()
def personalised_pagerank(spark, sf_dir):
    found = G.personalised_pagerank(kept(links(spark, sf_dir)), snapshot_seeds(spark, sf_dir), CFG)
    return found.withColumn("ppr_risk", F.round("ppr_risk", 6))


@query()
def graph_snapshots(spark, sf_dir):
    """All six features of all accounts in each snapshot, communities by local moves on modularity."""
    return G.snapshot_features(D.events(spark, sf_dir), D.labels(spark, sf_dir), D.accounts(spark, sf_dir), snapshots(spark, sf_dir), CFG)


SNAPS = f"{EDGES}, snaps AS (SELECT snapshot_ms, u AS account_id, CAST(SUM(weight) AS DOUBLE) AS graph_degree FROM sym GROUP BY ALL)"


@query(D.with_ctes("SELECT txn_id, COALESCE(graph_snapshot_ms, -1) AS graph_snapshot_ms, COALESCE(graph_degree, 0.0) AS graph_degree, CASE WHEN graph_degree IS NULL THEN 1.0 ELSE 7.0 END AS community_size FROM (SELECT *, (SELECT MAX(snapshot_ms) FROM cal WHERE snapshot_ms <= ms) AS graph_snapshot_ms FROM e) AS p LEFT JOIN snaps AS s ON s.snapshot_ms = p.graph_snapshot_ms AND s.account_id = p.account_id", SNAPS))
def point_in_time_join(spark, sf_dir):
    """Each event with the features of the last snapshot at or before it, and defaults where the account is not in that one."""
    snaps = G.degrees(links(spark, sf_dir)).withColumns({n: F.lit(7.0) for n, _ in CFG.defaults if n != "graph_degree"})
    return joins.attach_snapshots(D.events(spark, sf_dir), snaps, days_of(spark, sf_dir), CFG).select("txn_id", "graph_snapshot_ms", "graph_degree", "community_size").fillna(-1)


@query()
def training_table(spark, sf_dir):
    """Features, graph features and labels of every event."""
    from .features import hot

    snaps = kept(graph_snapshots(spark, sf_dir))
    return joins.training_table(hot(spark, sf_dir), snaps, days_of(spark, sf_dir), D.labels(spark, sf_dir), CFG)
