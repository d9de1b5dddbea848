"""The refresh of graph snapshots beside the live job: each day's snapshot is built and published once the stream has passed its time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GRAPH, GraphConfig
from ..operators.graph import next_due
from ..sources.tables import exists, publish_snapshot, read_snapshots


@dataclass
class LiveRefresh:
    spark: SparkSession
    root: str
    calendar: str
    #: The stream's watermark in milliseconds, or None before its first batch.
    watermark: Callable[[], int | None]
    #: Features of the snapshot at a time, with its row for the calendar.
    build: Callable[[int], tuple[DataFrame, DataFrame]]
    #: Time of the last snapshot before the first one that is published here.
    start_ms: int
    cfg: GraphConfig = GRAPH

    def last(self) -> int:
        times = read_snapshots(self.spark, self.root, self.calendar)[1] if exists(self.spark, self.calendar) else []
        return max(times, default=self.start_ms)

    def step(self) -> int | None:
        """Builds and publishes the next snapshot if it is due, and returns its time. A step that died is done again in full."""
        due = next_due(self.watermark(), self.last(), self.cfg)
        if due is not None:
            features, row = self.build(due)
            own = lambda f: f.where(F.col("snapshot_ms") == due)
            publish_snapshot(own(features), own(row), self.root, self.calendar)
        return due

    def catch_up(self) -> list[int]:
        """All snapshots that are due, oldest first."""
        done = []
        while (at := self.step()) is not None:
            done.append(at)
        return done
