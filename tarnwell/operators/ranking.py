"""Samples, splits and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, or all if it has fewer, by a hash of the key and the seed. Rows without a stratum are left out."""
    by = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    # Spark limits each task to the best n rows of a stratum before the shuffle (WindowGroupLimit)
    return df.where(F.col(stratum).isNotNull()).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def top_rows(df: DataFrame, group: str, metric: str, row_id: str, k: int, highest: bool = True, rank: str = "rank") -> DataFrame:
    """The k rows of the highest (or lowest) metric of each group; of equals the first. Null metrics don't rank."""
    by = Window.partitionBy(group).orderBy(F.desc(metric) if highest else F.asc(metric), row_id)
    return df.where(F.col(metric).isNotNull()).withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= k)


def first_rows(df: DataFrame, group: str, row_id: str, k: int) -> DataFrame:
    by = Window.partitionBy(group).orderBy(row_id)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def tail(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The last k rows of an order, in no certain order among each other."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(k)


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows (or all), those with the smallest hashes of key and seed: the same ones wherever they lie."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def contiguous(row_id: Column, total: int, parts: int) -> Column:
    """The number of the equal range that a row falls into."""
    return F.floor(row_id / max(1, -(-total // parts))).cast("long")


def best_of(df: DataFrame, groups: list[str], names: list[str], key: str) -> DataFrame:
    """groups, metric, key, value: the row with the greatest value of each metric; of equals the smallest key."""
    long = df.unpivot([*groups, key], names, "metric", "value")
    by = Window.partitionBy(*groups, "metric").orderBy(F.desc("value"), key)
    return long.where(F.col("value").isNotNull()).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
