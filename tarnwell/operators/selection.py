"""Exact ranks and quantiles by histograms, and exact splits, without a task that holds all rows.

Values become 64-bit whole numbers in the same order. The range that holds a wanted rank is cut
into some 65 000 equal bins, one aggregation counts them with the least and greatest value of
each, and the bin with the rank is the next range; a range of one value is the answer. As
bounds are those of values that are there, a few passes do, four for any 64 bits and one more
for the first bounds. Rows are read in each pass, but only histograms are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.scratch import settled

BINS = 1 << 16
#: Ranges up to which they are sent to all tasks (some 50 bytes each); beyond, they are joined by group.
BROADCAST_RANGES = 100_000
_LOW_63 = (1 << 63) - 1


def ordered_bits(value: Column) -> Column:
    """A double as a whole number in the same order: its bits, those of negative ones turned around. Null stays null."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value.cast("double"), F.lit(0.0))).cast("long")
    return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOW_63))).otherwise(bits))


def from_bits(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(_LOW_63))).otherwise(key)
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) for c in names])


def at_ranks(rows: DataFrame, groups: list[str], key: str, wanted: DataFrame) -> DataFrame:
    """groups, rank and value: the rank-th smallest (from 0) key of each group.

    rows: groups and a whole number key, nulls left out. wanted: groups and rank, each within its group.
    """
    rows = rows.select(*groups, F.col(key).cast("long").alias("_k")).where(F.col("_k").isNotNull())
    bounds = rows.groupBy(*groups).agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"))
    wanted = wanted.select(*groups, "rank").distinct()
    state = wanted.join(bounds, _same(wanted, bounds, groups)).select(*[wanted[c] for c in groups], "rank", F.lit(0).cast("long").alias("before"), "lo", "hi")
    state = settled(state)
    found = [state.where("lo = hi")]
    opened = state.where("lo < hi")
    while opened.take(1):
        ranges = settled(opened.select(*groups, "lo", "hi").distinct())
        few = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
        held = rows.join(few, _same(rows, ranges, groups) & rows["_k"].between(ranges["lo"], ranges["hi"])).select(*[rows[c] for c in groups], "_k", "lo", "hi")
        # a range over both signs may be wider than a whole number; there the high bits alone are the bin
        wide = F.shiftright("hi", 1) - F.shiftright("lo", 1) >= 1 << 61
        bins = F.when(wide, F.shiftright("_k", 47)).otherwise(F.expr(f"(_k - lo) div ((hi - lo) div {BINS} + 1)"))
        counts = held.groupBy(*groups, "lo", "hi", bins.alias("bin")).agg(F.count("*").alias("n"), F.min("_k").alias("least"), F.max("_k").alias("most"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*groups, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("below", below)  # at most BINS rows for each range
        inside = (F.col("rank") - F.col("before") >= F.col("below")) & (F.col("rank") - F.col("before") < F.col("below") + F.col("n"))
        pairs = opened.join(counts, _same(opened, counts, [*groups, "lo", "hi"]) & inside)
        state = settled(pairs.select(*[opened[c] for c in groups], "rank", (F.col("before") + F.col("below")).alias("before"), F.col("least").alias("lo"), F.col("most").alias("hi")))
        found.append(state.where("lo = hi"))
        opened = state.where("lo < hi")
    return reduce(DataFrame.unionByName, found).select(*groups, "rank", F.col("lo").alias("value"))


def quantiles(df: DataFrame, value: str, points: dict[str, float], groups: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """groups and a column for each point: the value at that share of the way from the least to the greatest, interpolated.

    Null values are left out; a group without any has nulls. Groups may be null.
    """
    names = list(groups)
    by = [f"_g{i}" for i in range(len(names))] or ["_g0"]
    kind = dict(df.dtypes)[value]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    keys = [F.col(g).alias(b) for g, b in zip(names, by)] or [F.lit(0).alias("_g0")]
    rows = df.select(*keys, (F.col(value).cast("long") if whole else ordered_bits(F.col(value))).alias("_k"))
    sizes = settled(rows.groupBy(*by).agg(F.count("_k").alias("n")))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.explode(F.array(*[f(place(p)).cast("long") for p in points.values() for f in (F.floor, F.ceil)]))
    found = at_ranks(rows, by, "_k", sizes.where("n > 0").select(*by, ranks.alias("rank")))
    found = found.select(*by, "rank", (F.col("value").cast("double") if whole else from_bits(F.col("value"))).alias("v"))
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks for each point

    def between(p: float) -> Column:
        low, high = (F.try_element_at("at", f(place(p)).cast("long")) for f in (F.floor, F.ceil))
        share = place(p) - F.floor(place(p))
        return F.when(share == 0, low).otherwise(low + (high - low) * share)

    return sizes.join(found, _same(sizes, found, by), "left").select(*[sizes[b].alias(g) for g, b in zip(names, by)], *[between(p).alias(c) for c, p in points.items()])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number from 0 for each row, in no certain order: rows are written with their places, and each task's are moved by the rows before it."""
    rows = settled(df.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    return rows.join(sizes.select("_p", "_first", before.alias("_before")), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_before")).select(*df.columns, name)


def exact_split(df: DataFrame, key: str, train: float, seed: int = 42) -> DataFrame:
    """Adds split: train for exactly int(rows * train) rows, those with the smallest hashes of key and seed, and validation for the others.

    The greatest hash of a training row is found as a rank; of the rows that share it (equal
    keys, null ones too), as many as are needed are taken.
    """
    rows = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    n = rows.count()
    wanted = int(n * train)
    if not 0 < wanted < n:
        return df.withColumn("split", F.lit("train" if wanted else "validation"))
    keyed = rows.select(F.lit(0).alias("_g"), "_h")
    ranks = df.sparkSession.createDataFrame([(0, wanted - 1)], "_g int, rank long")
    last = at_ranks(keyed, ["_g"], "_h", ranks).first()["value"]
    missing = wanted - rows.where(F.col("_h") < last).count()
    tied = numbered(rows.where(F.col("_h") == last), "_i")
    side = lambda taken: F.when(taken, "train").otherwise("validation").alias("split")
    return rows.where(F.col("_h") != last).select(*df.columns, side(F.col("_h") < last)).unionByName(tied.select(*df.columns, side(F.col("_i") < missing)))
