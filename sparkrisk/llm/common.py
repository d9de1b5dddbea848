"""What several operators share: reading a table, batches without pandas, reliable cuts of the lineage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A piece of an Arrow batch that is handled at once, so that rows of long texts do not pile up as Python objects.
ROWS_AT_ONCE = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that the scan reads nothing else."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def columns_of(batch: pa.RecordBatch) -> list[list]:
    return [batch.column(i).to_pylist() for i in range(batch.num_columns)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Stores:
    """What a worker remembers of words for the tasks of one operator: it goes once a task of another operator begins."""

    def __init__(self) -> None:
        self.owner, self.clear = "", []

    def begin(self, owner: str) -> None:
        if owner != self.owner:
            for clear in self.clear:
                clear()
            self.owner = owner


STORES = Stores()


def remembered(most: int) -> Callable:
    """lru_cache for word stores that a worker keeps between the tasks of one operator."""

    def cached(make: Callable) -> Callable:
        made = lru_cache(maxsize=most)(make)
        STORES.clear.append(made.cache_clear)
        return made

    return cached


@lru_cache(maxsize=1)
def trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def begin_task(owner: str) -> None:
    STORES.begin(owner)


def end_task() -> None:
    """Hands what a task has freed back to the system: a worker lives on, and with it what its allocators hold."""
    pa.default_memory_pool().release_unused()
    if trim():
        trim()(0)


def tidied(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """run, a task's work on batches, in a worker that keeps little of it. owner: the operator's module if run is not from there."""
    owner = owner or run.__module__

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        begin_task(owner)
        try:
            yield from run(batches)
        finally:
            end_task()

    return task


def map_rows(frame: DataFrame, schema: str, work: Callable[..., list]) -> DataFrame:
    """work takes a list per column and returns a list or an array per column of the schema; one task's rows at most are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        kinds = [ARROW[c.strip().split(" ")[1]] for c in schema.split(",")]
        for batch in slices(batches):
            out = work(*columns_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(out, kinds, strict=True)], names=names)

    return frame.mapInArrow(tidied(run, work.__module__), schema)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder if the session names one; a folder of our own only where that is unset, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}"))


#: A key is hot if it holds more than one of so many rows, so that fewer keys than this can be hot.
HOT_SHARE = 500


def hot_keys(counted: DataFrame, key: str, rows: int) -> DataFrame:
    """The hot keys among rows (key, n) that count `rows` rows in all: fewer than HOT_SHARE, known to the driver."""
    spark = counted.sparkSession
    found = counted.where((F.col("n") > max(100, rows // HOT_SHARE)) & F.col(key).isNotNull()).select(key)
    return spark.createDataFrame(found.collect(), found.schema)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with facts, which have one row per key at most. The facts of the hot keys are broadcast, so that no key gathers
    more than a small share of the rows in one task."""
    hot = F.broadcast(hot)
    among = rows.join(hot, key, "left_semi").join(F.broadcast(facts.join(hot, key, "left_semi")), key, how)
    return among.unionByName(rows.join(hot, key, "left_anti").join(facts, key, how))


def free_name(wanted: str, taken: list[str]) -> str:
    """The name, or with underscores behind it a name, that no column has; names differ in more than case."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


class Cuts(threading.local):
    """The folders of a thread's cut tables that are still there, in the order in which they were written."""

    def __init__(self) -> None:
        self.paths: list[str] = []


CUTS, PATH_OF = Cuts(), WeakKeyDictionary()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder: later jobs read them there, also after executors are lost. The shuffles
    that led to them are of no use any more; their files go as soon as the driver's garbage is collected."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    table = spark.read.schema(frame.schema).parquet(path)
    PATH_OF[table] = path
    CUTS.paths.append(path)
    return table


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame) -> None:
    """Removes cut tables that nothing reads any more."""
    for table in tables:
        path = PATH_OF.pop(table)
        if path in CUTS.paths:
            CUTS.paths.remove(path)
        remove(table.sparkSession, path)


def only(make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make(), cut; the tables that were cut on the way to them go."""
    before = len(CUTS.paths)
    table = cut(make())
    *others, own = CUTS.paths[before:]
    for path in others:
        remove(table.sparkSession, path)
    CUTS.paths[before:] = [own]
    return table
