"""Joins, resume logic and nesting."""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def union_tagged(tables: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """All rows of the tables with literal tags; columns that a table lacks are null."""
    tagged = [df.withColumns({k: F.lit(v) for k, v in tags.items()}) for df, tags in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def coalesce_merge(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left joins on the key; a column that is there already is filled up where it is null.

    Tables without the key or another column are skipped; a repeated key counts once, by
    its row with the smallest values, compared column by column.
    """
    out = base
    for other in others:
        extra = [c for c in other.columns if c != key]
        if key not in other.columns or not extra:
            continue
        # of a repeated key one whole row, never values of several
        one = other.groupBy(key).agg(F.min(F.struct(*extra)).alias("_row")).select(key, *[F.col("_row")[c].alias(f"_new_{c}") for c in extra])
        out = out.join(one, key, "left")
        out = out.withColumns({c: F.coalesce(c, f"_new_{c}") if c in out.columns else F.col(f"_new_{c}") for c in extra}).drop(*[f"_new_{c}" for c in extra])
    return out


def only_in(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    return df.join(sample.select(key), key, "left_semi")


def missing_in(sample: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return sample.join(df.select(key), key, "left_anti")


def nested(base: DataFrame, key: str, models: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """base with model_summaries: a struct (model_name, summary, category) of each model that has the id, in the order given.

    models: name, category, table, column. A repeated id counts by its greatest value.
    """
    parts = [t.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(c).alias("summary")).select(key, F.lit(i).alias("ord"), F.lit(name).alias("model_name"), "summary", F.lit(kind).alias("category")) for i, (name, kind, t, c) in enumerate(models)]
    lists = reduce(DataFrame.union, parts).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "model_name", "summary", "category"))).alias("s"))
    plain = F.transform("s", lambda x: F.struct(x["model_name"].alias("model_name"), x["summary"].alias("summary"), x["category"].alias("category")))
    return base.join(lists, key, "left").withColumn("model_summaries", F.coalesce(plain, F.array().cast("array<struct<model_name:string,summary:string,category:string>>"))).drop("s")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: str = "UNKNOWN") -> DataFrame:
    return df.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def open_work(rows: DataFrame, models: list[str], done: DataFrame, key: str) -> DataFrame:
    """Each row for each model, less what is done. models is a list in the plan; a row is copied once for each."""
    pairs = rows.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return pairs.join(done.select("model", key), ["model", key], "left_anti")


def override(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both tables; the new table's row wins."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def unpivot_models(wide: DataFrame, keys: list[str], excluded: list[str]) -> DataFrame:
    """keys, model, generated: a row for each column that is neither key nor excluded."""
    models = [c for c in wide.columns if c not in keys and c not in excluded]
    return wide.unpivot(keys, models, "model", "generated")


def by_position(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    return a.join(b, row_id)


def latest(df: DataFrame, key: str, time: str, row_id: str) -> DataFrame:
    """The row of the greatest time of each key; of equals the first."""
    by = Window.partitionBy(key).orderBy(F.desc_nulls_last(time), row_id)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def similar(above: float) -> Callable[..., Column]:
    """Ratcliff-Obershelp ratio of two texts; 0 where their counts of characters already keep it from being above the limit."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = (difflib.SequenceMatcher(None, x, y) for x, y in zip(a, b))
        return pd.Series([m.ratio() if m.quick_ratio() > above else 0.0 for m in pairs], dtype="float64")

    return ratio


def near_duplicates(texts: DataFrame, key: str, text: str, ratio: float = 0.9, parts: int = 16, sample: int | None = None, seed: int = 42) -> DataFrame:
    """key_a, key_b (the greater), ratio of all pairs whose Ratcliff-Obershelp ratio is above the limit, from 0 to under 1.

    Texts are compared where the lengths allow the ratio: such lengths are in one band or in
    two next to each other. Counts of characters rule out more pairs before the ratio is worked
    out. Both are upper bounds, so no pair is lost. A band is dealt over parts; pairs of like
    lengths still grow with the square of the texts, so texts of a corpus are joined by
    shingles elsewhere, or compared by a sample: `sample` rows (all if there are fewer), by a
    hash of key and seed. Rows with null key or text make no pair, nor do rows of the same key.
    """
    if not 0 <= ratio < 1:
        raise ValueError(f"ratio is from 0 to under 1, not {ratio}")
    # 2 * least / (a + b) > ratio keeps the lengths within a factor; a little more for rounding
    width = math.log((2 - ratio) / ratio) + 1e-6 if ratio else math.inf
    band = F.when(F.length(text) > 0, F.floor(F.log(F.length(text).cast("double")) / F.lit(width))).otherwise(0).cast("int")
    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    if sample is not None:
        rows = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample)
    side = lambda s, *more: rows.select(F.col(key).alias(f"key_{s}"), F.col(text).alias(f"t_{s}"), *more)
    a = side("a", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    b = side("b", band.alias("band"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    n_a, n_b = F.length("t_a"), F.length("t_b")
    # dealt out by hand: a small input would be broadcast, and all pairs made in the one task that reads it
    a, b = (x.repartition(parts, "band", "part") for x in (a, b))
    pairs = a.join(b, ["band", "part"]).where((F.col("key_a") < F.col("key_b")) & (2 * F.least(n_a, n_b) >= F.lit(ratio) * (n_a + n_b)))
    return pairs.select("key_a", "key_b", similar(ratio)("t_a", "t_b").alias("ratio")).where(F.col("ratio") > ratio)
