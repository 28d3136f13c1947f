"""Incremental runs: files as they come, and live usage windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def process_files(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Runs step over the files that are new since the last call and adds the results to out.

    The checkpoint remembers what is done, so a stopped run goes on where it was. Results
    are written by batch number: a batch that is run again overwrites what it had written.
    """
    rows = spark.readStream.schema(schema).format(format).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, time: str, tokens: str, seconds: int = 60, step: int = 10, late: str = "2 minutes") -> DataFrame:
    """Requests and tokens of sliding windows; later rows than the watermark are left out. For batches and streams."""
    stamped = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", f"{seconds} seconds", f"{step} seconds").alias("w")).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "tokens")
