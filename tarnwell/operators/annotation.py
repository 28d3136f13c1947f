"""Human evaluation: tasks, mappings, processed annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import text as tx
from tarnwell.operators.cleaning import missing_columns
from tarnwell.operators.ranking import stratified
from tarnwell.operators.relations import latest, lookup, missing_in, nested, only_in

#: Columns that a sample of cases needs.
CASE_COLUMNS = ["id", "subset_name", "synthetic_prompt", "judgement", "summary"]
FLAGS = ["hallucination", "incoherent", "publishable"]


def prepare(df: DataFrame, n: int, stratum: str = "subset_name", key: str = "id", columns: list[str] = CASE_COLUMNS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The sample of n cases (or all) of each stratum, with the needed columns, and its distribution over the strata."""
    if absent := missing_columns(df, columns):
        raise ValueError(f"Missing required columns: {', '.join(absent)}")
    sample = stratified(df, stratum, key, n, seed).select(*columns)
    return sample, sample.groupBy(stratum).agg(F.count("*").alias("n"))


def augment(base: DataFrame, models: list[tuple[str, str, DataFrame | None]], key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cases with model_summaries, the ids that each model lacks (model_name, key), and the number of summaries by model.

    models: column name, category and table with key and column, in the order of the list; a
    model whose table is None, or lacks the column, is skipped. Of a repeated id the greatest text counts.
    """
    known = [(name, kind, only_in(t.select(key, name), base, key), name) for name, kind, t in models if t is not None and name in t.columns]
    if not known:
        empty = base.withColumn("model_summaries", F.array().cast("array<struct<model_name:string,summary:string,category:string>>"))
        return empty, base.select(F.lit("").alias("model_name"), key).limit(0), base.sparkSession.createDataFrame([], "model_name string, n long")
    out = nested(base, key, known)
    lacking = [missing_in(base.select(key), t, key).select(F.lit(name).alias("model_name"), key) for name, _, t, _ in known]
    counts = out.select(F.explode("model_summaries.model_name").alias("model_name")).groupBy("model_name").agg(F.count("*").alias("n"))
    return out, reduce(DataFrame.unionByName, lacking), counts


def tasks(cases: DataFrame, key: str, items: str, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Annotation tasks (key, press_items, flat texts) and the mapping (key, press_id, model_name).

    items: array of struct (model_name, body). With a seed they are shuffled by a hash.
    """
    listed = F.col(items)
    if seed is not None:
        mixed = F.array_sort(F.transform(listed, lambda x: F.struct(F.xxhash64(F.col(key), x["model_name"], F.lit(seed)).alias("o"), x["model_name"].alias("model_name"), x["body"].alias("body"))))
        listed = F.transform(mixed, lambda x: F.struct(x["model_name"].alias("model_name"), x["body"].alias("body")))
    numbered = F.transform(listed, lambda x, i: F.struct(F.concat(F.lit("pr"), (i + 1).cast("string")).alias("id"), F.concat(F.lit("PR-"), (i + 1).cast("string")).alias("title"), x["body"].alias("body"), x["model_name"].alias("model_name")))
    made = cases.withColumn("_items", numbered)
    shown = F.transform("_items", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["body"].alias("body")))
    flat = F.map_from_entries(F.transform("_items", lambda x, i: F.struct(F.concat(F.lit("press"), (i + 1).cast("string")).alias("key"), F.concat(x["title"], F.lit("\n\n"), x["body"]).alias("value"))))
    mapping = made.select(key, F.explode("_items").alias("i")).select(key, F.col("i.id").alias("press_id"), F.col("i.model_name").alias("model_name"))
    return made.withColumn("press_items", shown).withColumn("press", flat).drop("_items", items), mapping


def process(exported: DataFrame, mapping: DataFrame, expected: int) -> tuple[DataFrame, DataFrame]:
    """Rows (case_id, press_id, model_name, rank, flags) of the latest annotation of each case, and errors of invalid ones.

    exported: case_id, id, updated_at, _row_id, rank (array of press ids, best first) and
    flags (map press id -> struct of the flag wordings).
    """
    case = F.coalesce(F.nullif(F.col("case_id"), F.lit("")), F.col("id").cast("string"))
    keyed = exported.withColumn("case_id", case).withColumn("_at", F.to_timestamp("updated_at"))
    last = latest(keyed, "case_id", "_at", "_row_id")
    empty = F.exists(F.map_values("flags"), lambda s: F.exists(F.array(*[s[f] for f in FLAGS]), lambda v: v == ""))
    problem = F.when(F.col("rank").isNull(), "no ranking").when(F.size("rank") != expected, "wrong number of ranks").when(empty, "empty quality field")
    checked = last.withColumn("problem", problem)
    rows = checked.where("problem is null").select("case_id", "flags", F.posexplode("rank").alias("pos", "press_id"))
    # a press id that is there twice has its last rank
    rows = rows.groupBy("case_id", "press_id").agg(F.max(F.col("pos") + 1).alias("rank"), F.max_by("flags", "pos").alias("flags"))
    rows = rows.withColumns({f: tx.annotation_flag(f, F.col("flags")[F.col("press_id")][f]) for f in FLAGS}).drop("flags")
    return lookup(rows, mapping, ["case_id", "press_id"], "model_name"), checked.where("problem is not null").select("case_id", "problem")


def model_metrics(rows: DataFrame) -> DataFrame:
    """model, count, avg_rank, ranks (sorted) and the rate of each flag."""
    return rows.groupBy(F.col("model_name").alias("model")).agg(
        F.count("*").alias("count"), F.avg("rank").alias("avg_rank"), F.sort_array(F.collect_list("rank")).alias("ranks"), *[F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in FLAGS]
    )


def by_case(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """One row for each case with its items by rank."""
    item = F.struct("rank", "press_id", "model_name", *FLAGS)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("press_items"))
