"""The live job: messages in, scored rows, alerts, holds and rejects out, each micro-batch exactly once.

A batch's features are computed by the batch operators over the batch and what the kept events hold of its accounts and entities, so
stream and batch cannot differ. Every output of a batch goes to a folder of its number and is written over when a batch is run
again after a crash; the stream's checkpoint says which batch that is. Readers see a batch once it is whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAY, GRAPH, STREAM, GraphConfig, StreamConfig
from ..operators.graph import next_due
from ..operators.joins import attach_snapshots
from ..operators.predicates import is_alert, on_hold
from ..operators.tables import kept
from ..operators.windows import hot_features
from ..schemas import FEATURE_SPEC_VERSION
from ..sources.tables import exists
from .source import parsed

KEYS = ("account_id", "device_id", "ip", "merchant_id")
EVENT_COLUMNS = ["txn_id", "ms", "account_id", "merchant_id", "merchant_category", "amount", "channel", "device_id", "ip", "lat", "lon", "city", "country", "status"]


@dataclass
class LiveJob:
    root: str
    accounts: DataFrame
    #: (snapshots, their times) as they are published when a batch begins.
    published: Callable[[], tuple[DataFrame, list[int]]]
    #: Features to scored rows, with risk and decision.
    score: Callable[[DataFrame], DataFrame]
    cfg: StreamConfig = STREAM
    graph: GraphConfig = GRAPH
    #: Called at "features", "scored" and "written" of each batch; tests raise here.
    at: Callable[[str, int], None] = lambda point, batch: None
    log: list[dict] = field(default_factory=list)

    def path(self, name: str, batch: int | None = None) -> str:
        return f"{self.root}/{name}" + ("" if batch is None else f"/batch={batch}")

    def read(self, spark: SparkSession, name: str, before: int) -> DataFrame | None:
        """What earlier batches have written."""
        if not exists(spark, self.path(name)):
            return None
        frame = spark.read.option("basePath", self.path(name)).parquet(self.path(name))
        return frame.where(F.col("batch") < before) if "batch" in frame.columns else None

    def check_version(self, spark: SparkSession) -> None:
        """Refuses to go on from state of another feature spec."""
        marker = f"{self.root}/spec"
        if not exists(spark, marker):
            spark.createDataFrame([(FEATURE_SPEC_VERSION,)], "spec string").write.mode("overwrite").parquet(marker)
        if (found := spark.read.parquet(marker).first()["spec"]) != FEATURE_SPEC_VERSION:
            raise ValueError(f"the state is of feature spec {found}, not {FEATURE_SPEC_VERSION}")

    def world(self, new: DataFrame, past: DataFrame | None) -> DataFrame:
        """The new events and all earlier ones that share an account or an entity with them."""
        new = new.withColumn("_new", F.lit(True))
        if past is None:
            return new
        touched = None
        for k in KEYS:
            hit = past.join(new.select(k).distinct(), k, "left_semi")
            touched = hit.select(*EVENT_COLUMNS) if touched is None else touched.union(hit.select(*EVENT_COLUMNS))
        return touched.distinct().withColumn("_new", F.lit(False)).unionByName(new)

    def __call__(self, messages: DataFrame, batch: int) -> None:
        spark = messages.sparkSession
        good, bad = parsed(messages)
        new = good.dropDuplicates(["txn_id"]).select(*EVENT_COLUMNS, "ingest_ts")
        past = self.read(spark, "events", batch)
        if past is not None:
            new = new.join(past.select("txn_id"), "txn_id", "left_anti")
        new = kept(new)
        snapshots, calendar = self.published()
        found = hot_features(self.world(new.select(*EVENT_COLUMNS), past), self.accounts).where("_new").drop("_new")
        self.at("features", batch)
        holds = self.read(spark, "holds", batch)
        held = on_hold(found, holds, self.cfg.hold_ttl) if holds is not None else found.withColumn("account_on_hold", F.lit(False))
        placed = attach_snapshots(held, snapshots, calendar, self.graph).join(new.select("txn_id", "ingest_ts"), "txn_id")
        scored = kept(self.score(placed).withColumns({"scored_ts": F.unix_millis(F.current_timestamp()), "date": F.timestamp_millis("ms").cast("date")}))
        self.at("scored", batch)
        write = lambda f, name: f.write.mode("overwrite").option("compression", "zstd")
        write(scored, "scored").partitionBy("date").parquet(self.path("scored", batch))
        write(scored.where(F.col("decision") == "HOLD").select("account_id", "ms"), "holds").parquet(self.path("holds", batch))
        write(scored.where(is_alert()), "alerts").parquet(self.path("alerts", batch))
        write(bad, "rejected").parquet(self.path("rejected", batch))
        # last of all: an event that is here was scored
        write(new.select(*EVENT_COLUMNS), "events").parquet(self.path("events", batch))
        self.at("written", batch)
        facts = scored.agg(F.count("*").alias("rows"), F.max("ms").alias("watermark_ms"), F.count(F.when(is_alert(), 1)).alias("alerts")).first()
        self.log.append({"batch": batch, "rows": facts["rows"], "watermark_ms": facts["watermark_ms"], "alerts": facts["alerts"]})

    def start(self, stream: DataFrame, **trigger):
        """Runs the job; trigger as for writeStream, all that is there once by default."""
        self.check_version(stream.sparkSession)
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", self.path("checkpoint")).trigger(**(trigger or {"availableNow": True})).start()


def scored_rows(spark: SparkSession, root: str) -> DataFrame:
    """All scored rows of a job."""
    return spark.read.option("basePath", f"{root}/scored").parquet(f"{root}/scored").drop("batch")


def due_snapshot(watermark_ms: int | None, calendar: list[int], cfg: GraphConfig = GRAPH) -> int | None:
    """The snapshot that a refresh should build next: a hook after each batch."""
    return next_due(watermark_ms, max(calendar), cfg) if calendar else None


def initial_entities(uses: DataFrame, retention: int = 30 * DAY) -> DataFrame:
    """Last uses of entities worth loading into new state: those within the retention of the newest."""
    newest = uses.agg(F.max("ms").alias("newest"))
    return uses.join(F.broadcast(newest)).where(F.col("ms") >= F.col("newest") - retention).drop("newest")
