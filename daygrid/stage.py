"""Stored intermediate tables.

An operator that reads its input along several branches (statistics joined
back, carries between blocks) would scan the raw events once per branch.
``stage`` writes the much smaller panel once, so the branches read that table
and a lost executor re-reads it instead of recomputing the events.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local session may make its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    folder = tempfile.mkdtemp(prefix="daygrid-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def session_folder(spark: SparkSession) -> str:
    """Where this session stores its tables: all of them are gone when this one folder is."""
    return f"{checkpoint_root(spark)}/daygrid/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as parquet under the session's folder and read it back; a filter on ``partition_by`` skips files."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)
