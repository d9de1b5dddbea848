"""Reading and writing tables, views, checkpoints and logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import earliest_copy
from ..schemas import FEATURE_SPEC_VERSION, SCORED_EXTRA, EVENTS


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are scanned."""
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def read_all(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-free digest of each table."""
    from ..functions.scalar import fingerprint

    out = [fingerprint(f).select(F.lit(n).alias("table"), "n", "digest") for n, f in tables.items()]
    first = out[0]
    for other in out[1:]:
        first = first.union(other)
    return first


def account_directory(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, ["account_id", "created_ms", "home_city", "home_lat", "home_lon"])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; a row that does not fit the schema is an error."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file with one mapping."""
    value = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write(frame: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet with zstd; the commit protocol makes files appear whole or not at all, and clears what failed tasks left."""
    out = frame.write.mode(mode).option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def compacted(frame: DataFrame, rows_per_file: int) -> DataFrame:
    """As few files as hold the rows."""
    return frame.repartition(max(1, -(-frame.count() // rows_per_file)))


def scored_schema() -> T.StructType:
    return T.StructType([*EVENTS.fields, *SCORED_EXTRA.fields])


def scored_view(spark: SparkSession, root: str, name: str = "scored") -> DataFrame:
    """The scored rows without redelivered copies, as a view; an empty one until there are files. Schemas that have grown are merged."""
    if exists(spark, root):
        rows = spark.read.option("mergeSchema", True).parquet(root)
        frame = earliest_copy(rows, order=("scored_ts", *[c for c in ("stream_id", "consumer") if c in rows.columns]))
    else:
        frame = spark.createDataFrame([], scored_schema())
    frame.createOrReplaceTempView(name)
    return frame


class HistoryLeak(ValueError):
    """History reaches beyond its boundary."""


def history(events: DataFrame, boundary_ms: int, cut: bool = True) -> DataFrame:
    """Events before the boundary; with cut=False an event at or after it is an error."""
    if not cut and not events.where(F.col("ms") >= boundary_ms).isEmpty():
        raise HistoryLeak(f"events at or after {boundary_ms}")
    return events.where(F.col("ms") < boundary_ms)


def graph_input(past: DataFrame, live: DataFrame, snapshot_ms: int) -> DataFrame:
    """History and live events before a snapshot, as one table."""
    return past.unionByName(live, allowMissingColumns=True).where(F.col("ms") < snapshot_ms)


def snapshot_path(root: str, snapshot_ms: int) -> str:
    return f"{root}/snapshot_ms={snapshot_ms}"


def publish_snapshot(features: DataFrame, calendar_row: DataFrame, root: str, calendar_path: str) -> None:
    """The snapshot's rows first, its row in the calendar last: readers go by the calendar and never see half a snapshot. Published
    again, as after a crash, a snapshot replaces its own rows and keeps its row in the calendar."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("snapshot_ms").parquet(root)
    if exists(calendar_row.sparkSession, calendar_path):
        listed = calendar_row.sparkSession.read.parquet(calendar_path).select("snapshot_ms")
        calendar_row = calendar_row.join(listed, "snapshot_ms", "left_anti")
    write(calendar_row, calendar_path, mode="append")


def read_snapshots(spark: SparkSession, root: str, calendar_path: str) -> tuple[DataFrame, list[int]]:
    """Published snapshots and their times."""
    times = sorted(r["snapshot_ms"] for r in spark.read.parquet(calendar_path).select("snapshot_ms").distinct().collect())  # a row per day
    return spark.read.parquet(root).where(F.col("snapshot_ms").isin(times)), times


def write_checkpoint(state: DataFrame, path: str, spec: str = FEATURE_SPEC_VERSION) -> None:
    """Account state as gzipped JSON with the feature spec that it belongs to."""
    state.withColumn("spec", F.lit(spec)).write.mode("overwrite").option("compression", "gzip").json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The state, unless any of it belongs to another spec."""
    frame = spark.read.json(path, schema=T.StructType([*schema.fields, T.StructField("spec", T.StringType())]))
    if not frame.where(~F.col("spec").eqNullSafe(FEATURE_SPEC_VERSION)).isEmpty():
        raise ValueError(f"state of another feature spec than {FEATURE_SPEC_VERSION}")
    return frame.drop("spec")


def newest(frame: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows in the order: what a bounded list keeps."""
    return frame.orderBy(*[F.desc(c) for c in order]).limit(n)


def append_log(spark: SparkSession, path: str, entry: dict) -> None:
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "entry string").write.mode("append").text(path)


def once(spark: SparkSession, marker: str, work, force: bool = False) -> bool:
    """Runs work unless its marker is there; the marker is written last, so an interrupted run is done again."""
    if not force and exists(spark, marker):
        return False
    work()
    spark.range(1).write.mode("overwrite").parquet(marker)
    return True


def report(profile: DataFrame) -> str:
    """A profile (a row per feature) as a Markdown table."""
    rows = profile.collect()
    head = "| " + " | ".join(profile.columns) + " |\n|" + "---|" * len(profile.columns)
    shown = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join([head, *("| " + " | ".join(shown(v) for v in r) + " |" for r in rows)])
