"""Connected components: forests within tasks, then alternating large and small stars in joins and aggregations.

Self loops and rows with a null end are left out; repeated edges count once. No edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, hot_keys, spread_join, tidied

#: Edges of which a task makes a forest.
EDGES_AT_ONCE = 1_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, parent = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def forest(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u > v) that tie each node of a task's edges to the smallest node that it reaches by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            node, root = roots(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            other = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], names=["u", "v"])

    return edges.repartition(tasks).mapInArrow(tidied(run), "u long, v long")


def least_of(rows: DataFrame, edges: int) -> tuple[DataFrame, DataFrame]:
    """The smallest v and the hot ones of the u of rows (u, v)."""
    found = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return found.select("u", F.least("m", "u").alias("m")), hot_keys(found, "u", edges)


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = edges.union(edges.select("v", "u"))
    least, hot = least_of(both, 2 * n)
    return spread_join(both.where("v > u"), least, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these. Edges have u > v."""
    least, hot = least_of(edges, n)
    tied = spread_join(edges, least, "u", hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def following(now: DataFrame, after: DataFrame) -> DataFrame:
    """What was made of the table `now`, which goes."""
    after = cut(after)
    drop(now)
    return after


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have edges (two columns of long); a component's name is its smallest node."""
    a, b = edges.columns
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
    before, after = None, print_of(now)
    tasks = -(-after[0] // EDGES_AT_ONCE)
    if tasks:
        now = following(now, forest(now, tasks).distinct())
        before, after = (after, after) if tasks == 1 else (None, print_of(now))  # one task's forest is that of all edges
    while before != after and after[0]:
        now = following(now, large_star(now, after[0]))
        now = following(now, small_star(now, now.count()))
        before, after = after, print_of(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
