"""Cutting lineage in iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share; in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = getattr(spark, "_tallyframe_folder", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark._tallyframe_folder = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
    return own


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, so rounds do not pile up plans."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and not getattr(spark, "_tallyframe_checkpoints", False):
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        spark._tallyframe_checkpoints = True
    return df.checkpoint()
