"""The account graph: projection of shared entities, node features, communities, personalised PageRank, and daily snapshots.

Snapshots are built together: every row carries its snapshot_ms, and all joins and groups have it in their keys, so a calendar of
snapshots is one plan. Communities are found per connected component, which bounds what a task holds to one component; components of
more than MOST_EDGES edges are found by label propagation in joins instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GRAPH, GraphConfig
from .tables import kept

#: Edges of a component that one task may hold.
MOST_EDGES = 2_000_000


def calendar(spark, first_ms: int, last_ms: int, cfg: GraphConfig = GRAPH) -> DataFrame:
    """snapshot_ms from first to last, both included; none if the last is before the first."""
    return spark.range(first_ms, last_ms + 1, cfg.cadence, 1).toDF("snapshot_ms")


def in_lookback(events: DataFrame, snapshots: DataFrame, cfg: GraphConfig = GRAPH) -> DataFrame:
    """Events copied to each snapshot T of the calendar with ms in [T - lookback, T). The calendar is bounded (a row per day)."""
    days = F.broadcast(snapshots.select("snapshot_ms"))
    return events.join(days, (F.col("ms") < F.col("snapshot_ms")) & (F.col("ms") >= F.col("snapshot_ms") - cfg.lookback))


def memberships(placed: DataFrame, cfg: GraphConfig = GRAPH) -> DataFrame:
    """Distinct (snapshot_ms, kind, entity, account_id) of the entities whose number of accounts is within the caps."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("entity"), F.lit(cap).alias("cap")) for k, cap in cfg.caps])).alias("use")
    pairs = placed.select("snapshot_ms", "account_id", kinds).select("snapshot_ms", "account_id", "use.*").where("entity is not null").distinct()
    sizes = pairs.groupBy("snapshot_ms", "kind", "entity", "cap").agg(F.count("*").alias("accounts"))
    fit = sizes.where((F.col("accounts") >= cfg.least_accounts) & (F.col("accounts") <= F.col("cap"))).drop("cap", "accounts")
    return pairs.drop("cap").join(fit, ["snapshot_ms", "kind", "entity"])


def capped_entities(placed: DataFrame, kind: str, cfg: GraphConfig = GRAPH) -> DataFrame:
    """Entities of one kind within the cap, with their number of accounts."""
    return memberships(placed, cfg).where(F.col("kind") == kind).groupBy("snapshot_ms", "entity").agg(F.count("*").alias("accounts"))


def edges(members: DataFrame) -> DataFrame:
    """(snapshot_ms, u, v, weight), u < v: how many entities two accounts share. The caps bound the pairs of an entity."""
    a = members.select("snapshot_ms", "kind", "entity", F.col("account_id").alias("u"))
    b = members.select("snapshot_ms", "kind", "entity", F.col("account_id").alias("v"))
    return a.join(b, ["snapshot_ms", "kind", "entity"]).where("u < v").groupBy("snapshot_ms", "u", "v").agg(F.count("*").alias("weight"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("snapshot_ms", "u", "v", "weight").union(links.select("snapshot_ms", "v", "u", "weight"))


def degrees(links: DataFrame) -> DataFrame:
    """Weighted degree."""
    return both_ways(links).groupBy("snapshot_ms", F.col("u").alias("account_id")).agg(F.sum("weight").cast("double").alias("graph_degree"))


def clustering(links: DataFrame) -> DataFrame:
    """Unweighted clustering coefficient. Edges point from the end of smaller degree, so that hubs open few wedges."""
    d = both_ways(links).groupBy("snapshot_ms", F.col("u").alias("account_id")).agg(F.count("*").alias("d"))
    key = lambda c: F.struct(F.col(f"d{c}").alias("d"), F.col(c).alias("node"))
    placed = links.select("snapshot_ms", "u", "v").join(d.select("snapshot_ms", F.col("account_id").alias("u"), F.col("d").alias("du")), ["snapshot_ms", "u"]).join(d.select("snapshot_ms", F.col("account_id").alias("v"), F.col("d").alias("dv")), ["snapshot_ms", "v"])
    out = placed.select("snapshot_ms", F.when(key("u") < key("v"), F.col("u")).otherwise(F.col("v")).alias("a"), F.when(key("u") < key("v"), F.col("v")).otherwise(F.col("u")).alias("b"), F.greatest(key("u"), key("v")).alias("kb"))
    first, second = out, out.select("snapshot_ms", "a", F.col("b").alias("c"), F.col("kb").alias("kc"))
    wedges = first.join(second, ["snapshot_ms", "a"]).where("kb < kc").select("snapshot_ms", "a", "b", "c")
    closed = wedges.join(out.select("snapshot_ms", F.col("a").alias("b"), F.col("b").alias("c")), ["snapshot_ms", "b", "c"])
    corners = closed.select("snapshot_ms", F.explode(F.array("a", "b", "c")).alias("account_id")).groupBy("snapshot_ms", "account_id").agg(F.count("*").alias("t"))
    value = F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return d.join(corners, ["snapshot_ms", "account_id"], "left").select("snapshot_ms", "account_id", value.alias("graph_clustering"))


def connected(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(snapshot_ms, account_id, component): the smallest account that can be reached. Labels jump along their own labels."""
    sym = both_ways(links).select("snapshot_ms", "u", "v")
    labels = kept(sym.groupBy("snapshot_ms", F.col("u").alias("account_id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    for _ in range(most_rounds):
        near = sym.join(labels.withColumnsRenamed({"account_id": "v", "component": "c"}), ["snapshot_ms", "v"]).groupBy("snapshot_ms", F.col("u").alias("account_id")).agg(F.min("c").alias("c"))
        step = labels.join(near, ["snapshot_ms", "account_id"]).select("snapshot_ms", "account_id", F.col("component").alias("before"), F.least("component", "c").alias("component"))
        jump = step.select("snapshot_ms", F.col("account_id").alias("component"), F.col("component").alias("far"))
        now = kept(step.join(jump, ["snapshot_ms", "component"]).select("snapshot_ms", "account_id", "before", F.col("far").alias("component")))
        if now.where("before <> component").isEmpty():
            return now.drop("before")
        labels = now.drop("before")
    raise RuntimeError("the components did not settle")


def louvain(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Communities of nodes 0..n-1 by local moves and aggregation, in a seeded order; equal gains go to the smaller community."""
    rng, member = np.random.default_rng(seed), np.arange(n)
    total = float(w.sum())
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        loops = np.zeros(n)
        for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
            if a == b:
                loops[a] += x
            else:
                near[a][b] = near[a].get(b, 0.0) + x
                near[b][a] = near[b].get(a, 0.0) + x
        degree = np.array([sum(d.values()) for d in near]) + 2 * loops
        label, mass, moved_any = np.arange(n), degree.copy(), False
        order = rng.permutation(n)
        moved = True
        while moved:
            moved = False
            for node in order.tolist():
                own, d = int(label[node]), degree[node]
                mass[own] -= d
                share: dict[int, float] = {own: 0.0}
                for other, x in near[node].items():
                    share[int(label[other])] = share.get(int(label[other]), 0.0) + x
                gain = {c: x - mass[c] * d / (2 * total) for c, x in share.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                label[node] = best
                mass[best] += d
                if best != own:
                    moved = moved_any = True
        if not moved_any:
            return member
        _, label = np.unique(label, return_inverse=True)
        member = label[member]
        a, b = label[u], label[v]
        n = int(label.max()) + 1
        code, at = np.unique(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b), return_inverse=True)
        u, v, w = code // n, code % n, np.bincount(at, weights=w)


def modularity(u: np.ndarray, v: np.ndarray, w: np.ndarray, label: np.ndarray) -> float:
    total = w.sum()
    degree = np.bincount(u, w, len(label)) + np.bincount(v, w, len(label))
    inside = w[label[u] == label[v]].sum() / total
    return float(inside - (np.bincount(label, degree) ** 2).sum() / (2 * total) ** 2)


def communities(links: DataFrame, cfg: GraphConfig = GRAPH, most_edges: int = MOST_EDGES) -> DataFrame:
    """(snapshot_ms, account_id, community). Names of communities have no meaning beyond their snapshot."""
    parts = connected(links)
    placed = kept(links.join(parts.withColumnRenamed("account_id", "u"), ["snapshot_ms", "u"]))
    sizes = placed.groupBy("snapshot_ms", "component").agg((F.count("*") > most_edges).alias("large"))
    placed = kept(placed.join(sizes, ["snapshot_ms", "component"]))
    kind = links.schema["u"].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["u", "v"])
        names = np.unique(np.r_[frame["u"].to_numpy(), frame["v"].to_numpy()])
        u, v = np.searchsorted(names, frame["u"].to_numpy()), np.searchsorted(names, frame["v"].to_numpy())
        label = louvain(u, v, frame["weight"].to_numpy(dtype=float), len(names), cfg.seed)
        _, first = np.unique(label, return_index=True)
        return pd.DataFrame({"snapshot_ms": frame["snapshot_ms"].iloc[0], "account_id": names, "community": names[first[label]]})

    schema = f"snapshot_ms long, account_id {kind}, community {kind}"
    small = placed.where("not large").groupBy("snapshot_ms", "component").applyInPandas(one, schema)
    large = placed.where("large")
    return small if large.isEmpty() else small.unionByName(propagated(large))


def propagated(links: DataFrame, rounds: int = 20) -> DataFrame:
    """Communities by weighted label propagation: each round a node takes the label with the most weight around it, itself included."""
    sym = both_ways(links)
    ends = sym.groupBy("snapshot_ms", F.col("u").alias("account_id")).agg(F.max("weight").alias("own"))
    labels = kept(ends.select("snapshot_ms", "account_id", F.col("account_id").alias("community")))
    for _ in range(rounds):
        votes = sym.join(labels.withColumnRenamed("account_id", "v"), ["snapshot_ms", "v"]).select("snapshot_ms", F.col("u").alias("account_id"), "community", "weight")
        votes = votes.union(labels.join(ends, ["snapshot_ms", "account_id"]).select("snapshot_ms", "account_id", "community", "own"))
        sums = votes.groupBy("snapshot_ms", "account_id", "community").agg(F.sum("weight").alias("w"))
        labels = kept(sums.groupBy("snapshot_ms", "account_id").agg(F.max_by("community", F.struct("w", "community")).alias("community")))
    return labels


def community_features(groups: DataFrame, members: DataFrame, accounts: DataFrame, cfg: GraphConfig = GRAPH) -> DataFrame:
    """Per account: its community's size, devices that two or more of its members share, and the share of its accounts of known age
    that were created less than `young` before the snapshot."""
    key = ["snapshot_ms", "community"]
    devices = members.where("kind = 'device_id'").join(groups, ["snapshot_ms", "account_id"]).groupBy(*key, "entity").agg(F.count("*").alias("n")).where("n >= 2").groupBy(*key).agg(F.count("*").alias("devices"))
    young = F.avg((F.col("created_ms") > F.col("snapshot_ms") - cfg.young).cast("double"))
    sizes = groups.join(accounts.select("account_id", "created_ms"), "account_id", "left").groupBy(*key).agg(F.count("*").alias("community_size"), F.coalesce(young, F.lit(0.0)).alias("community_young_share"))
    facts = sizes.join(devices, key, "left").withColumn("community_shared_devices", F.coalesce("devices", F.lit(0))).drop("devices")
    return groups.join(facts, key).drop("community")


def seed_accounts(labels: DataFrame, events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot_ms, account_id) of accounts with fraud whose label was there before the snapshot."""
    fraud = labels.where("is_fraud = 1").select("txn_id", "label_ms").join(events.select("txn_id", "account_id"), "txn_id").groupBy("account_id").agg(F.min("label_ms").alias("label_ms"))
    return fraud.join(F.broadcast(snapshots.select("snapshot_ms")), F.col("label_ms") < F.col("snapshot_ms")).select("snapshot_ms", "account_id")


def personalised_pagerank(links: DataFrame, seeds: DataFrame, cfg: GraphConfig = GRAPH, tolerance: float = 1e-9, most_rounds: int = 200) -> DataFrame:
    """(snapshot_ms, account_id, ppr_risk): the rank times the snapshot's number of nodes; 0 in a snapshot without seeds.

    All snapshots iterate together in joins, until no snapshot's ranks move by more than the tolerance in sum."""
    out = both_ways(links)
    weights = kept(out.groupBy("snapshot_ms", "u").agg(F.sum("weight").alias("d")))
    flow = kept(out.join(weights, ["snapshot_ms", "u"]).select("snapshot_ms", "u", "v", (F.col("weight") / F.col("d")).alias("share")))
    nodes = weights.select("snapshot_ms", F.col("u").alias("account_id"))
    present = seeds.join(nodes, ["snapshot_ms", "account_id"], "left_semi")
    counts = nodes.groupBy("snapshot_ms").agg(F.count("*").alias("n")).join(present.groupBy("snapshot_ms").agg(F.count("*").alias("s")), "snapshot_ms", "left")
    base = nodes.join(counts, "snapshot_ms").join(present.withColumn("seed", F.lit(1)), ["snapshot_ms", "account_id"], "left")
    base = kept(base.select("snapshot_ms", "account_id", "n", F.coalesce(F.col("seed") / F.col("s"), F.lit(0.0)).alias("start"), F.col("s").isNotNull().alias("seeded")))
    rank = kept(base.where("seeded").select("snapshot_ms", "account_id", "start", F.col("start").alias("r")))
    for _ in range(most_rounds):
        pushed = flow.join(rank.select("snapshot_ms", F.col("account_id").alias("u"), "r"), ["snapshot_ms", "u"]).groupBy("snapshot_ms", F.col("v").alias("account_id")).agg(F.sum(F.col("r") * F.col("share")).alias("p"))
        moved = rank.join(pushed, ["snapshot_ms", "account_id"], "left").select("snapshot_ms", "account_id", "start", F.col("r").alias("before"), ((1 - cfg.alpha) * F.col("start") + cfg.alpha * F.coalesce("p", F.lit(0.0))).alias("r"))
        moved = kept(moved)
        gap = moved.groupBy("snapshot_ms").agg(F.sum(F.abs(F.col("r") - F.col("before"))).alias("g")).agg(F.max("g")).first()[0]
        rank = moved.drop("before")
        if gap is None or gap < tolerance:
            break
    return base.join(rank.select("snapshot_ms", "account_id", "r"), ["snapshot_ms", "account_id"], "left").select("snapshot_ms", "account_id", (F.coalesce("r", F.lit(0.0)) * F.col("n")).alias("ppr_risk"))


def snapshot_features(events: DataFrame, labels: DataFrame, accounts: DataFrame, snapshots: DataFrame, cfg: GraphConfig = GRAPH) -> DataFrame:
    """All six features of every account in each snapshot's graph."""
    members = kept(memberships(in_lookback(events, snapshots, cfg), cfg))
    links = kept(edges(members))
    key = ["snapshot_ms", "account_id"]
    groups = kept(communities(links, cfg))
    ranks = personalised_pagerank(links, seed_accounts(labels, events, snapshots), cfg)
    return degrees(links).join(clustering(links), key).join(community_features(groups, members, accounts, cfg), key).join(ranks, key)


def snapshot_stats(links: DataFrame, groups: DataFrame, seeds: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The calendar's row of each snapshot: nodes, edges, communities and seeds in the graph; zeros where it is empty."""
    nodes = groups.groupBy("snapshot_ms").agg(F.count("*").alias("n_nodes"), F.countDistinct("community").alias("n_communities"))
    count = lambda f, name: f.groupBy("snapshot_ms").agg(F.count("*").alias(name))
    inside = seeds.join(groups, ["snapshot_ms", "account_id"], "left_semi")
    out = snapshots.select("snapshot_ms").join(nodes, "snapshot_ms", "left").join(count(links, "n_edges"), "snapshot_ms", "left").join(count(inside, "n_seeds"), "snapshot_ms", "left")
    return out.fillna(0)


def next_due(watermark_ms: int | None, last_ms: int, cfg: GraphConfig = GRAPH) -> int | None:
    """The next snapshot's time, once the stream's watermark has reached it."""
    due = last_ms + cfg.cadence
    return due if watermark_ms is not None and watermark_ms >= due else None
