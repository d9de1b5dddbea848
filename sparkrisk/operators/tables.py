"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def kept(frame: DataFrame) -> DataFrame:
    """The rows, written to the folder that the session shares (spark.checkpoint.dir; one of our own only where it is unset)."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}"))
    return frame.checkpoint(eager=True)
