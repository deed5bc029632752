"""Reliable checkpoints for results that several branches of a plan read."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without one gets a temporary folder; on a cluster the folder
    must be shared, so its absence is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="verseflux-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder; it survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of results that nothing refers to any more.

    It does so when the driver's heap is collected, which a driver with little to do may put off
    until the files fill the disks. For loops that checkpoint one result after the other.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
