"""Shared helpers of the corpus operators: work tables, folds, Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where it is unset, local sessions (tests) get a fresh one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarnwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Written tables that cut lineage; they go by `release`, or when the Python process ends.

    Lost executors don't matter to a written table: its files are in the folder of
    spark.checkpoint.dir, and a failed task of its writer is run again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        _OPEN.add(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}/{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        """Deletes the tables of these names; only for tables that no result will read."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self) -> None:
        _OPEN.discard(self)
        try:
            self._delete(self.path)
        except Exception:  # the session has ended: nothing left to ask
            pass


_OPEN: set[Workspace] = set()


def opened() -> set[Workspace]:
    """The work tables that are there."""
    return set(_OPEN)


@atexit.register
def release() -> None:
    """Deletes all work tables. Results are read from them, so only when the results so far have been used or written."""
    for workspace in list(_OPEN):
        workspace.drop()


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds, F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about size bytes in the given binary or string column; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, held = 0, 0
        lengths = np.diff(offsets_of(batch.column(column)))
        ends = np.cumsum(lengths)
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, held + size, "right")))
            yield batch.slice(start, stop - start)
            start, held = stop, int(ends[stop - 1])


def offsets_of(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1]


def payload(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array and the offsets of its values in them (nulls are empty)."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    at = offsets_of(array).astype(np.int64)
    if not array.buffers()[2]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(array.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


_BLANKS = re.compile(rb"[ \t-\r]")


def word_parts(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text between blanks and \\x09-\\x0D, as lists of about step bytes, so that a long text is never a list of all its words."""
    start = 0
    while start < len(text):
        stop = start + step
        if stop < len(text):
            blank = _BLANKS.search(text, stop)
            stop = blank.start() if blank else len(text)
        if words := text[start:stop].split():
            yield words
        start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of all runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def arrow(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=False) for f in schema], schema=schema)
