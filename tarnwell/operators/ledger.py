"""Answers of models, kept by what was asked.

A ledger is a folder of Parquet files, one row for each call: the digest of model, options and
request, the answer, and the error if the call failed. `ask` calls the model for the different
requests that have no answer yet, in waves that are each appended by one job, and joins the
answers back by digest. So a request is called once, however many rows ask it, however often
a plan that uses its answer runs, and in every later run; a run that was stopped goes on with
the waves that it lacks. Rows are never joined by their ids: as many come out as went in, null
and repeated ones too. Failed calls are tried again by the next `ask`.

A task that is lost within a wave is run again, with its calls; its rows are appended once.
Each wave is a folder of its own, which counts when its writer has left its mark.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.adapters import ModelConfig, answered
from tarnwell.sources.scratch import settled
from tarnwell.sources.tables import folders, path_exists

#: How texts are written: smaller than by Spark's own choice.
SMALL = "zstd"
SCHEMA = "digest string, model string, answer string, error string"


def request_digest(config: ModelConfig, ruling: Column, prompt: Column) -> Column:
    """SHA-256 of what decides an answer: the model's name, kind and options, and both texts, null as empty."""
    model = json.dumps([config.name, config.kind, config.options], sort_keys=True, default=str)
    ruling, prompt = (F.coalesce(c.cast("string"), F.lit("")) for c in (ruling, prompt))
    # the length tells where the first text ends
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), F.octet_length(ruling).cast("string"), F.lit("\n"), ruling, prompt).cast("binary"), 256)


class Ledger:
    """Answers in a folder that all machines share.

    every: requests of a wave, the most that a stopped run loses.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 100_000):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every

    def calls(self) -> DataFrame:
        """A row for each call so far."""
        # waves are named one by one: plans with different waves must not pass for the same scan
        waves = [w for w in folders(self.spark, self.folder) if path_exists(self.spark, f"{w}/_SUCCESS")]
        return self.spark.read.schema(SCHEMA).parquet(*waves) if waves else self.spark.createDataFrame([], SCHEMA)

    def answers(self, model: str | None = None) -> DataFrame:
        """digest, answer and error of each request, or of those to one model: an answer before an error, of several the smallest."""
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "answer", "error"))
        calls = self.calls() if model is None else self.calls().where(F.col("model") == model)
        return calls.groupBy("digest").agg(best.alias("a")).select("digest", "a.answer", "a.error")

    def ask(self, rows: DataFrame, config: ModelConfig, ruling: Column, prompt: Column, out: str = "generated", error: str = "error", where: Column | None = None) -> DataFrame:
        """As `adapters.answered`, by the ledger: the calls are made now, the result can be used any number of times."""
        if taken := {out, error} & set(rows.columns):
            raise ValueError(f"columns are there already: {sorted(taken)}")
        digest = request_digest(config, ruling, prompt)
        asked = rows.select("*", (digest if where is None else F.when(where, digest)).alias("_digest"))
        requests = asked.where(F.col("_digest").isNotNull()).select(F.col("_digest").alias("digest"), ruling.cast("string").alias("ruling"), prompt.cast("string").alias("prompt"))
        known = self.calls().where((F.col("model") == config.name) & F.col("error").isNull()).select("digest")
        if not known.isEmpty():
            # digests alone tell which requests are open; texts are moved only if there are any, and only theirs
            wanted = settled(requests.select("digest").distinct().join(known, "digest", "left_anti"))
            requests = wanted.select("digest", F.lit("").alias("ruling"), F.lit("").alias("prompt")) if wanted.isEmpty() else requests.join(wanted, "digest", "left_semi")
        # equal digests are equal requests, so any one stands for all
        opened = settled(requests.dropDuplicates(["digest"]), SMALL)
        waves = -(-opened.count() // self.every)
        for k in range(waves):
            wave = opened.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == k)
            made = answered(wave, config, F.col("ruling"), F.col("prompt"), "answer", "error")
            made.select("digest", F.lit(config.name).alias("model"), "answer", "error").write.parquet(f"{self.folder}/wave-{uuid.uuid4().hex}", compression=SMALL)
        found = self.answers(config.name).select(F.col("digest").alias("_digest"), F.col("answer").alias(out), F.col("error").alias(error))
        return asked.join(found, "_digest", "left").select(*rows.columns, out, error)
