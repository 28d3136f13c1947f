"""Folders for tables that a plan writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name in spark.checkpoint.dir, which all machines share; local sessions without one get a folder that goes with the process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tarnwell-scratch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def settled(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df written once and read again, so that what uses it twice doesn't work it out twice."""
    path = scratch(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
