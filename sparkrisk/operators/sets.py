"""Sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranged import offsets, range_of


def total_order(events: DataFrame) -> DataFrame:
    return events.orderBy("ms", "txn_id")


def numbered(frame: DataFrame, *order: str) -> DataFrame:
    """Rows with their place from 0 in the order, whose first column is numeric."""
    ranged = frame.withColumn("_part", range_of(frame, order[0]))
    before = offsets(ranged, "_part", {"_offset": F.count("*")})
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    joined = ranged.withColumn("_k", inside).join(F.broadcast(before), "_part")  # a row per range
    return joined.withColumn("position", F.col("_k") + F.col("_offset")).drop("_part", "_k", "_offset")


def batches(frame: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows with the number of their batch of that size."""
    return numbered(frame, *order).withColumn("batch", F.floor(F.col("position") / size))


def replay_window(events: DataFrame, start_ms: int, end_ms: int, start_at: int | None = None, limit: int | None = None) -> DataFrame:
    """Events of [start, end), from start_at if given, in total order, the first `limit` of them if given."""
    from ..schemas import no_labels

    low = max(start_ms, start_at) if start_at is not None else start_ms
    out = total_order(no_labels(events).where((F.col("ms") >= low) & (F.col("ms") < end_ms)))
    return out.limit(limit) if limit is not None else out


def united(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows by column name; a column that a frame lacks is null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def with_ids(frame: DataFrame, *order: str, prefix: str = "T") -> DataFrame:
    """Ids by position in the order."""
    from ..functions.scalar import padded_id

    return numbered(frame, *order).withColumn("txn_id", padded_id(prefix, "position")).drop("position")
