"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Stages decide by row, never by id: null and repeated ids are documents like any others. Of
copies the row with the smallest id stays, null ids last, of equal ids any one. Null texts
have no terms, shingles, passages or windows and go through all stages; empty tables stay
empty. Texts are worked on whole. Extra columns are kept as they are, whatever their names,
but for n_chars, which follows the text; only the row key's own name is taken. A stage's
result must be written before the next stage is called, as `run` does: work tables of the
stages before it are deleted then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import bpe, decontam, ngram_join, sa_dedup, toxicity
from tarnwell.llm.common import Workspace, fold, opened, read
from tarnwell.llm.queries import TOKENIZER

#: Ids up to which the removed ones are broadcast (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Column that tells rows apart within a stage, as ids may be null or repeated.
KEY = "_row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row, written once so that it stays the same."""
    return Workspace(docs.sparkSession).table(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def by_key(rows: DataFrame) -> DataFrame:
    """Key, as doc_id, and text."""
    return rows.select(F.col(KEY).alias("doc_id"), "text")


def without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """rows less those whose key is in gone, without the key."""
    gone = Workspace(rows.sparkSession).table(gone, name)
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, KEY, "left_anti").drop(KEY)


_spent: set[Workspace] = set()


def tidy(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, which first deletes the work tables of the stages before it, but for those that docs is read from.

    A stage's result is written before the next one starts, so nothing reads them again.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sources = docs.inputFiles()
        for work in list(_spent):
            if not any(work.path in file for file in sources):
                work.drop()
                _spent.discard(work)
        before = opened()
        out = stage(spark, docs, sf_dir)
        _spent.update(opened() - before)
        return out

    return run_stage


@tidy
def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.7 or more."""
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.reject(docs, machine, 0.7)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest id (null last), of each component of similar ones."""
    rows = keyed(docs)
    found = ngram_join.join(by_key(rows)).select(F.col("doc_id").alias(KEY), "component_id")
    found = Workspace(spark).table(found.join(rows.select(KEY, F.col("doc_id").cast("long")), KEY), "components")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    first = found.groupBy("component_id").agg(F.min(rank)[KEY].alias("kept"), F.count("*").alias("n")).where("n > 1")
    first = Workspace(spark).table(first, "first")  # as a table, so that the join can split a large component
    gone = found.join(first, "component_id").where(F.col(KEY) != F.col("kept")).select(KEY)
    return without(rows, gone, "copies")


@tidy
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes or more that an earlier document, or place, has."""
    names = docs.columns
    # the other columns go along as one, so that none can clash with what dedup adds
    done = sa_dedup.dedup(docs.select("doc_id", "text", F.struct(*[c for c in names if c != "text"]).alias(KEY)), keep="first", whole_chars=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    changed = {"text": text, "n_chars": F.coalesce(F.length(text).cast("long"), F.col(KEY)["n_chars"]) if "n_chars" in names else None}
    return done.select(*[changed[c].alias(c) if c in changed else F.col(KEY)[c].alias(c) for c in names])


@tidy
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    rows = keyed(docs)
    found = decontam.find(by_key(rows), read(spark, sf_dir, "benchmark"))
    return without(rows, found.where(F.size("spans") > 0).select(F.col("doc_id").alias(KEY)), "leaks")


@tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all that is left."""
    return bpe.digests(docs, TOKENIZER)


STAGES = [("toxicity", detoxify), ("ngram_join", near_duplicates), ("suffix_dedup", repeats), ("decontam", decontaminate), ("bpe", encode)]

#: The trained, iterative and byte-level stages have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    work = Workspace(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
