"""Windows over time, running sums and rows before against plain Python."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import rolling

START = datetime.datetime(1969, 12, 31, 23, 58)  # times before and after 1970
EVENTS = "i int, ts timestamp, n double, g string"


def events(n, groups, seed, span=900):
    rng = random.Random(seed)
    times = [START + datetime.timedelta(seconds=rng.choice([rng.randrange(span), rng.random() * span, 300])) for _ in range(n)]
    return [(i, None if rng.random() < 0.03 else at, rng.choice([0.0, 1.0, 2.5, 7.0, None]), rng.choice(groups)) for i, at in enumerate(times)]


def window(rows, row, seconds):
    _, at, _, g = row
    mine = [x for x in rows if x[3] == g]
    if at is None:
        return [x for x in mine if x[1] is None]
    return [x for x in mine if x[1] is not None and at - datetime.timedelta(seconds=seconds) <= x[1] <= at]


@pytest.mark.parametrize("groups,seconds", [(["a", "b", None], 60), (["a"], 60), (["a"], 7.5), ([None], 1000)])
def test_usage(spark, groups, seconds):
    rows = events(300, groups, 1)
    want = {}
    for row in rows:
        seen = window(rows, row, seconds)
        values = [x[2] for x in seen if x[2] is not None]
        want[row[0]] = (len(seen), sum(values) if values else None)
    df = spark.createDataFrame(rows, EVENTS).repartition(4)
    assert {r.i: (r.requests, r.tokens) for r in rolling.usage(df, "ts", {"tokens": "n"}, "g", seconds).collect()} == want
    if len(groups) == 1:
        assert {r.i: (r.requests, r.tokens) for r in rolling.usage(df, "ts", {"tokens": "n"}, None, seconds).collect()} == want


@pytest.mark.parametrize("groups,limit,seconds", [(["a", None], 20, 60), (["a"], 0, 60), (["a"], 35.5, 90.5)])
def test_waits(spark, groups, limit, seconds):
    rows, want = events(300, groups, 2), {}
    for row in rows:
        own = sorted((x[1], x[2] or 0.0) for x in window(rows, row, seconds)) if row[1] else []
        over, held, want[row[0]] = sum(n for _, n in own) - limit, 0.0, 0.0
        for k, (when, n) in enumerate(own if over > 0 else ()):
            held += n
            if held >= over and (k + 1 == len(own) or own[k + 1][0] != when):  # calls of one time expire together
                want[row[0]] = max(0.0, (when - row[1]).total_seconds() + seconds)
                break
    df = spark.createDataFrame(rows, EVENTS).repartition(4)
    got = {r.i: r.wait_seconds for r in rolling.waits(df, "ts", "n", limit, "g", seconds).collect()}
    assert got == pytest.approx(want, abs=1e-6) and any(want.values())
    if len(groups) == 1:
        assert {r.i: r.wait_seconds for r in rolling.waits(df, "ts", "n", limit, None, seconds).collect()} == got


def test_running_and_previous(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(40), rng.choice([None, 1.0, 2.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string, o int, v double").repartition(5)
    got = {r.i: r for r in rolling.previous(rolling.running(df, ["o"], {"s": F.col("v"), "c": F.lit(1)}, "g"), ["o", "i"], {"before": "i"}, "g").collect()}
    assert len(got) == len(rows)
    for i, g, o, _ in rows:
        seen = [x for x in rows if x[1] == g and x[2] <= o]
        values = [x[3] for x in seen if x[3] is not None]
        assert (got[i].s, got[i].c) == (sum(values) if values else None, len(seen))
        earlier = [(x[2], x[0]) for x in rows if x[1] == g and (x[2], x[0]) < (o, i)]
        assert got[i].before == (max(earlier)[1] if earlier else None)
    alone = rolling.previous(df.select("i"), ["i"], {"before": "i"}).collect()
    assert {r.i: r.before for r in alone} == {i: i - 1 if i else None for i in range(400)}
    assert rolling.running(df.limit(0), ["o"], {"s": F.col("v")}, "g").count() == 0


def test_one_group_is_many_tasks(spark):
    """A budget that all calls share is dealt out by time; nothing goes to one task."""
    df = spark.createDataFrame(events(2000, ["a"], 5, 40_000), EVENTS)
    for made in (rolling.usage(df, "ts", {"tokens": "n"}), rolling.waits(df, "ts", "n", 3)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "hashpartitioning(_b" in plan and made.count() == 2000
    # a hot moment: as many rows as it likes, one moment to the window
    hot = spark.range(5000).select(F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit(1.0).alias("n"))
    assert {(r.requests, r.tokens) for r in rolling.usage(hot, "ts", {"tokens": "n"}).collect()} == {(5000, 5000.0)}
