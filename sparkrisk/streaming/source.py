"""Event sources of streams, and a producer that feeds a folder for tests and replays."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STREAM, StreamConfig
from ..functions.scalar import millis
from ..operators.sets import batches
from ..schemas import EVENTS, MESSAGES, from_message, problem, split_valid, to_message


def messages(spark: SparkSession, folder: str, most_files: int = 1) -> DataFrame:
    """The messages that arrive in a folder as JSON lines, so many files at a time. Another source (Kafka and the like) takes its place
    as long as it gives the same columns."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", most_files).json(folder)


def typed(stream: DataFrame) -> DataFrame:
    """Events with `ms`, and `ts` as the event time that watermarks need."""
    return from_message(stream).withColumns({"ms": millis("event_time"), "ts": F.col("event_time").cast("timestamp")})


def parsed(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events of a batch of messages, and those that are none, with the message as it came and what is wrong."""
    raw = F.to_json(F.struct(*batch.columns))
    typed_batch = batch.select(F.struct(*batch.columns).alias("m"), raw.alias("message")).select("m.*", "message")
    events = from_message(typed_batch).withColumn("ms", millis("event_time"))
    good, _ = split_valid(events)
    with_message = typed_batch.select("message", *MESSAGES.names)
    checked = with_message.select("message", F.struct(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in EVENTS]).alias("e")).select("message", "e.*").withColumn("problem", problem())
    return good, checked.where("problem is not null").select("message", "problem")


def once(stream: DataFrame, delay: str = "48 hours", key: str = "txn_id") -> DataFrame:
    """Each event once: copies that come within the delay of the first are dropped, and what was seen is forgotten after it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def late(stream_batch: DataFrame, watermark_ms: int | None) -> tuple[DataFrame, DataFrame]:
    """Events at or after the watermark, and those before it. None are lost: the late ones go to a side output."""
    if watermark_ms is None:
        return stream_batch, stream_batch.where("false")
    return stream_batch.where(F.col("ms") >= watermark_ms), stream_batch.where(F.col("ms") < watermark_ms)


class Pace:
    """How long to wait before an event: by event time sped up, at a fixed rate, or not at all."""

    def __init__(self, speedup: float | None = None, rate: float | None = None, clock: Callable[[], float] = time.monotonic):
        if speedup is not None and rate is not None:
            raise ValueError("give a speedup or a rate")
        self.speedup, self.rate, self.clock, self.begin, self.first, self.sent = speedup, rate, clock, clock(), None, 0

    def wait(self, ms: int, n: int = 1) -> float:
        """Seconds until n events, the first of them at ms, are due."""
        self.first = ms if self.first is None else self.first
        due = (ms - self.first) / 1000.0 / self.speedup if self.speedup else self.sent / self.rate if self.rate else 0.0
        self.sent += n
        return max(0.0, due - (self.clock() - self.begin))


class Backpressure:
    """Paused once the lag is above the upper mark, until it is below the lower one. An unknown lag does not pause."""

    def __init__(self, cfg: StreamConfig = STREAM):
        self.cfg, self.paused = cfg, False

    def blocks(self, lag: int | None) -> bool:
        if lag is not None:
            self.paused = lag >= self.cfg.lag_resume if self.paused else lag > self.cfg.lag_pause
        return self.paused


def publish(events: DataFrame, folder: str, size: int = STREAM.batch, pace: Pace | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Writes events in total order, a file per batch, for a stream to read. Returns how many batches. For replays: a driver loop."""
    numbered = batches(events, size, "ms", "txn_id").cache()
    ends = numbered.groupBy("batch").agg(F.min("ms").alias("ms"), F.count("*").alias("n")).orderBy("batch").collect()
    for row in ends:
        if pace:
            sleep(pace.wait(row["ms"], row["n"]))
        one = numbered.where(F.col("batch") == row["batch"]).orderBy("ms", "txn_id")
        to_message(one, F.unix_millis(F.current_timestamp())).coalesce(1).write.mode("append").json(folder)
    numbered.unpersist()
    return len(ends)

