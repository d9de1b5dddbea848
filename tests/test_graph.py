import itertools

import numpy as np
import pytest

from sparkrisk.config import DAY, GRAPH
from sparkrisk.operators import graph, joins

T = 1_769_904_000_000
HERE = "snapshot_ms long, u string, v string, weight long"


def use(account, days, device=None, ip=None):
    return (T - int(days * DAY), account, device, ip)


def members(spark, rows):
    events = spark.createDataFrame(rows, "ms long, account_id string, device_id string, ip string")
    return graph.memberships(graph.in_lookback(events, graph.calendar(spark, T, T)))


def test_projection(spark):
    rows = [use("A", 1, "D1", "I1"), use("B", 2, "D1", "I1"), use("C", 31, "D1"), use("D", 0, "D1"), use("E", 30, "D1")]
    got = {(r["u"], r["v"]): r["weight"] for r in graph.edges(members(spark, rows)).collect()}
    assert got == {("A", "B"): 2, ("A", "E"): 1, ("B", "E"): 1}  # T itself and what is older than the lookback are out


@pytest.mark.parametrize("n,kept", [(16, True), (17, False)])
def test_caps_are_inclusive(spark, n, kept):
    got = members(spark, [use(f"A{k:02}", 1, "D1") for k in range(n)]).count()
    assert got == (n if kept else 0)


def links(spark, edges):
    return spark.createDataFrame([(T, u, v, w) for u, v, w in edges], HERE)


def test_degree_clustering_components(spark):
    e = links(spark, [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "d", 3), ("x", "y", 1)])
    assert {r["account_id"]: r["graph_degree"] for r in graph.degrees(e).collect()} == {"a": 3, "b": 3, "c": 5, "d": 3, "x": 1, "y": 1}
    got = {r["account_id"]: r["graph_clustering"] for r in graph.clustering(e).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 1.0, "c": 1 / 3, "d": 0.0, "x": 0.0, "y": 0.0})
    assert {r["account_id"]: r["component"] for r in graph.connected(e).collect()} == dict(zip("abcdxy", "aaaaxx", strict=True))


def test_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1) for c in "pq" for i, j in itertools.combinations(range(5), 2)]
    e = links(spark, [*cliques, ("p0", "q0", 1)])
    got = {r["account_id"]: r["community"] for r in graph.communities(e).collect()}
    assert len(set(got.values())) == 2 and all(got[f"{c}{i}"] == got[f"{c}0"] for c in "pq" for i in range(5))
    spread = {r["account_id"]: r["community"] for r in graph.propagated(e).collect()}
    assert len({spread[f"p{i}"] for i in range(5)}) == 1


def test_louvain_improves_modularity():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    u, v = np.minimum(u, v), np.maximum(u, v)
    u, v = u[u != v], v[u != v]
    w = np.ones(len(u))
    label = graph.louvain(u, v, w, 60, 42)
    assert (label == graph.louvain(u, v, w, 60, 42)).all()
    assert graph.modularity(u, v, w, label) > graph.modularity(u, v, w, np.arange(60)) + 0.1


def test_pagerank_against_numpy(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "d", 3), ("x", "y", 1)]
    seeds = spark.createDataFrame([(T, "a"), (T, "nobody")], "snapshot_ms long, account_id string")
    got = {r["account_id"]: r["ppr_risk"] for r in graph.personalised_pagerank(links(spark, edges), seeds).collect()}
    names = sorted({n for u, v, _ in edges for n in (u, v)})
    m = np.zeros((len(names),) * 2)
    for u, v, w in edges:
        m[names.index(v), names.index(u)] += w
        m[names.index(u), names.index(v)] += w
    m /= m.sum(axis=0)
    start = np.array([n == "a" for n in names], dtype=float)
    want = np.linalg.solve(np.eye(len(names)) - GRAPH.alpha * m, (1 - GRAPH.alpha) * start) * len(names)
    assert got == pytest.approx(dict(zip(names, want, strict=True)), abs=1e-6)
    none = graph.personalised_pagerank(links(spark, edges), seeds.where("false"))
    assert {r["ppr_risk"] for r in none.collect()} == {0.0}


def test_point_in_time_join(spark):
    snaps = spark.createDataFrame([(T, "A", 5.0), (T + DAY, "B", 9.0)], "snapshot_ms long, account_id string, graph_degree double")
    for name, value in GRAPH.defaults[1:]:
        from pyspark.sql import functions as F

        snaps = snaps.withColumn(name, F.lit(value + 1))
    rows = [(1, T - 1, "A"), (2, T, "A"), (3, T + DAY - 1, "A"), (4, T + DAY, "A"), (5, T + DAY, "B"), (6, T, "Z")]
    events = spark.createDataFrame(rows, "txn_id long, ms long, account_id string")
    got = {r["txn_id"]: (r["graph_snapshot_ms"], r["graph_degree"], r["community_size"]) for r in joins.attach_snapshots(events, snaps, [T, T + DAY]).collect()}
    assert got == {1: (None, 0.0, 1.0), 2: (T, 5.0, 2.0), 3: (T, 5.0, 2.0), 4: (T + DAY, 0.0, 1.0), 5: (T + DAY, 9.0, 2.0), 6: (T, 0.0, 1.0)}


def test_seeds_and_due(spark):
    labels = spark.createDataFrame([(1, 1, T), (2, 1, T - 1), (3, 0, T - 1)], "txn_id long, is_fraud int, label_ms long")
    events = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "txn_id long, account_id string")
    assert [r["account_id"] for r in graph.seed_accounts(labels, events, graph.calendar(spark, T, T)).collect()] == ["B"]
    assert graph.next_due(T + DAY, T) == T + DAY and graph.next_due(T + DAY - 1, T) is None and graph.next_due(None, T) is None


def test_snapshots_of_the_whole_table(spark, monkeypatch):
    """Each event after the first day has a snapshot less than a day old, and seeds keep the labels' delay. Ranks are left out."""
    from pyspark.sql import functions as F

    from sparkrisk.plans import queries as engine
    from sparkrisk.sources import driver

    from .conftest import SMALL

    given = []

    def unranked(links, seeds, cfg):
        given.append((links, seeds))
        return graph.degrees(links).select("snapshot_ms", "account_id", F.lit(0.0).alias("ppr_risk"))

    monkeypatch.setattr(graph, "personalised_pagerank", unranked)
    ms = [r["ms"] for r in driver.events(spark, SMALL).select("ms").collect()]
    days = list(range((min(ms) // DAY + 1) * DAY, max(ms) // DAY * DAY + 1, DAY))
    assert len(days) > 20
    table = engine.queries()["training_table"](spark, SMALL).select((F.col("ms") - F.col("graph_snapshot_ms")).alias("age"), "ms").collect()
    assert len(table) == len(ms) and all(r["age"] is None if r["ms"] < days[0] else 0 <= r["age"] < DAY for r in table)
    engine.queries()["personalised_pagerank"](spark, SMALL)
    for links, seeds in given:
        assert links.agg(F.max("snapshot_ms")).first()[0] > days[0] + 7 * DAY
        assert seeds.agg(F.min("snapshot_ms")).first()[0] > min(ms) + GRAPH.label_delay
    assert len(given) == 2
