"""Windows over time, running sums and rows before, without a task that holds a whole group.

What looks back over a span of time is worked out in buckets as long as the span. A window
that ends in a bucket begins in it or in the one before, so each moment is there twice: in its
own bucket, and as the halo of the next one. Tasks follow groups and buckets. Rows of one
moment see the same window, so they are added up first, within each task before the shuffle:
a hot group or moment is as many rows as it has different moments.

What runs over all rows of a group is worked out in blocks: rows are dealt out by range of
group and order, each block is summed by itself, block totals are scanned (as many rows as
there are blocks), and carried into the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.scratch import settled


def _groups(group: str | list[str] | None) -> list[str]:
    return [group] if isinstance(group, str) else list(group or [])


def moments(events: DataFrame, time: str, values: dict[str, Column], group: str | list[str] | None = None) -> DataFrame:
    """_g0.. (groups), _t (microseconds), _n (rows) and the sums of values of each moment of each group."""
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(_groups(group))]
    rows = events.select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), *[v.alias(k) for k, v in values.items()])
    return rows.groupBy(*[f"_g{i}" for i in range(len(keys))], "_t").agg(F.count("*").alias("_n"), *[F.sum(k).alias(k) for k in values])


def with_halo(rows: DataFrame, seconds: float) -> DataFrame:
    """Each moment in its own bucket (_b, _own true) and in the next one. Moments without a time are in none."""
    span = F.lit(int(seconds * 1_000_000))
    b = ((F.col("_t") - F.pmod("_t", span)) / span).cast("long")  # a multiple, so the division is exact
    return rows.where(F.col("_t").isNotNull()).withColumn("_own_b", b).select("*", F.explode(F.array("_own_b", F.col("_own_b") + 1)).alias("_b")).withColumn("_own", F.col("_b") == F.col("_own_b")).drop("_own_b")


def _back(events: DataFrame, time: str, found: DataFrame, names: list[str], group: str | list[str] | None) -> DataFrame:
    """events with what was found for their moments."""
    same = F.unix_micros(F.col(time).cast("timestamp")).eqNullSafe(F.col("_t"))
    for i, g in enumerate(_groups(group)):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return events.join(found, same, "left").select(*[events[c] for c in events.columns], *names)


def usage(events: DataFrame, time: str, tokens: dict[str, str], group: str | list[str] | None = None, seconds: float = 60) -> DataFrame:
    """Adds requests, and a sum for each of tokens, of the last seconds up to and with each call. Calls exactly that old still count.

    group: one budget for each of its values (null is one); without it all calls share one.
    Calls of one time count each other; calls without a time see only each other.
    """
    keys = [f"_g{i}" for i in range(len(_groups(group)))]
    sums = {f"_s{i}": F.col(c) for i, c in enumerate(tokens.values())}
    rows = moments(events, time, sums, group)
    span = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(-int(seconds * 1_000_000), Window.currentRow)
    timed = with_halo(rows, seconds).select(*keys, "_t", "_own", F.sum("_n").over(span).alias("requests"), *[F.sum(s).over(span).alias(name) for s, name in zip(sums, tokens)]).where("_own").drop("_own")
    untimed = rows.where(F.col("_t").isNull()).select(*keys, "_t", F.col("_n").alias("requests"), *[F.col(s).alias(name) for s, name in zip(sums, tokens)])
    return _back(events, time, timed.unionByName(untimed), ["requests", *tokens], group)


def waits(events: DataFrame, time: str, tokens: str, limit: float, group: str | list[str] | None = None, seconds: float = 60) -> DataFrame:
    """Adds wait_seconds: how long a call must wait until enough tokens of the calls before it have expired.

    The calls within the last seconds expire in their order; the first at which the running
    sum reaches what is over the limit gives the time. With S the running sum from the start
    of the halo on, that is the first moment whose own S reaches S - limit of the waiting one.
    It lies within the window, so within bucket and halo: sums and limits are put in one order
    there, and each limit takes the next sum after it. Calls of the same time expire together.
    Tokens are not negative; nulls count as none. Calls without a time don't wait.
    """
    keys, micros = [f"_g{i}" for i in range(len(_groups(group)))], int(seconds * 1_000_000)
    rows = with_halo(moments(events, time, {"_v": F.coalesce(F.col(tokens).cast("double"), F.lit(0.0))}, group), seconds)
    by = Window.partitionBy(*keys, "_b").orderBy("_t")
    rows = rows.withColumns({"_s": F.round(F.sum("_v").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 9), "_in": F.round(F.sum("_v").over(by.rangeBetween(-micros, Window.currentRow)), 9)})
    # each moment is there as a sum at its own place, and those that must wait also as a limit at what must have expired
    must = F.col("_own") & (F.col("_in") > limit)
    sides = F.array(F.struct(F.col("_s").alias("v"), F.lit(1).alias("side")), F.when(must, F.struct(F.round(F.col("_s") - F.lit(float(limit)), 9).alias("v"), F.lit(0).alias("side"))))
    both = rows.select(*keys, "_b", "_t", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("e")).select(*keys, "_b", "_t", "e.v", "e.side")
    # from the greatest down, so that the last sum seen is the next one up
    down = Window.partitionBy(*keys, "_b").orderBy(F.desc("v"), F.desc("side"), F.desc("_t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_first", F.last(F.when(F.col("side") == 1, F.col("_t")), True).over(down)).where("side = 0")
    found = found.select(*keys, "_t", (F.greatest(F.col("_first") + micros - F.col("_t"), F.lit(0)) / 1_000_000).alias("_wait"))
    out = _back(events, time, found, ["_wait"], group)
    return out.select(*events.columns, F.coalesce("_wait", F.lit(0.0)).alias("wait_seconds"))


def in_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _block: rows dealt out by range of the order, equal ones together, numbered in order. Written once, so that numbers stay."""
    return settled(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))


def previous(df: DataFrame, order: list[str], columns: dict[str, str], group: str | list[str] | None = None) -> DataFrame:
    """Adds for each of columns (new name: column) its value in the row before, in the group and order given; the first has null.

    Rows that are equal in order and group have no certain order among each other.
    """
    keys = _groups(group)
    rows = in_blocks(df, [*keys, *order])
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    values = F.struct(*[F.col(c).alias(new) for new, c in columns.items()])
    rows = rows.withColumns({"_before": F.lag(values).over(within), "_first": F.row_number().over(within) == 1})
    # the last row of each block, handed on to the next block of its group
    ends = rows.groupBy(*keys, "_block").agg(F.max_by(values, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_end")
    same = F.col("_block") == F.col("_eb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    ends = ends.select("_carried", F.col("_block").alias("_eb"), *[F.col(k).alias(f"_e_{k}") for k in keys])
    out = rows.join(ends, same, "left").withColumn("_prev", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
    return out.select(*df.columns, *[F.col("_prev")[new].alias(new) for new in columns])


def running(df: DataFrame, order: list[str], sums: dict[str, Column], group: str | list[str] | None = None) -> DataFrame:
    """Adds running sums: of all rows up to and with each one in the group and order given; rows equal in both count each other."""
    keys = _groups(group)
    by = [*keys, *order]
    # equal rows have one running sum, so they are added up first
    steps = df.select(*by, *[v.alias(f"_v{i}") for i, v in enumerate(sums.values())]).groupBy(*by).agg(*[F.sum(f"_v{i}").alias(f"_v{i}") for i in range(len(sums))])
    rows = in_blocks(steps, by)
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_v{i}").alias(f"_v{i}") for i in range(len(sums))])
    carried = totals.select(F.col("_block").alias("_cb"), *[F.col(k).alias(f"_c_{k}") for k in keys], *[F.sum(f"_v{i}").over(before).alias(f"_c{i}") for i in range(len(sums))])
    same = F.col("_block") == F.col("_cb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    # null where no row so far has a value
    total = lambda i: F.coalesce(F.col(f"_c{i}") + F.sum(f"_v{i}").over(within), F.sum(f"_v{i}").over(within), F.col(f"_c{i}"))
    done = rows.join(carried, same, "left").select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(by)], *[total(i).alias(new) for i, new in enumerate(sums)])
    match = F.lit(True)
    for j, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{j}"))
    return df.join(done, match, "left").select(*df.columns, *sums)


def deltas(df: DataFrame, order: str, time: str, count: str, goal: int = 1000, group: str | list[str] | None = None) -> DataFrame:
    """Seconds and rows between consecutive checkpoints, rows an hour, and hours left to the goal."""
    at = F.col(time).cast("timestamp").cast("double")
    out = previous(df.withColumn("_at", at), [order], {"_at_before": "_at", "_n_before": count}, group)
    out = out.select(*df.columns, (F.col("_at") - F.col("_at_before")).alias("seconds"), (F.col(count) - F.col("_n_before")).alias("added"))
    rate = F.when(F.col("seconds") > 0, F.col("added") / F.col("seconds") * 3600)
    return out.withColumn("per_hour", rate).withColumn("hours_left", F.when(rate > 0, F.greatest(F.lit(goal) - F.col(count), F.lit(0)) / rate))
