"""Ranks, quantiles and exact splits against sorted lists."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import selection


@pytest.mark.parametrize("kind,make", [
    ("bigint", lambda r: r.choice([r.randrange(-(1 << 63), 1 << 63), r.randrange(10), (1 << 63) - 1, -(1 << 63), None])),
    ("int", lambda r: r.randrange(5)),
    ("double", lambda r: r.choice([r.gauss(0, 1), r.random() * 1e300, -r.random() * 1e-300, 0.0, float("inf"), None])),
])
def test_ranks_and_quantiles(spark, kind, make):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), make(rng)) for _ in range(600)] + [("one", make(random.Random(3))), ("none", None)]
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(5)
    points = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    if kind == "double":
        got = {r.g: r for r in selection.quantiles(df, "v", {"q0": 0.0, "q100": 1.0}, ["g"]).collect()}
        finite = df.where("v IS NULL OR v < double('inf')")
    else:
        got, finite = {}, df
    got2 = {r.g: r for r in selection.quantiles(finite, "v", points, ["g"]).collect()}
    assert set(got2) == {g for g, v in rows if kind != "double" or v != float("inf")}
    for g, r in got2.items():
        values = sorted(v for h, v in rows if h == g and v is not None and v != float("inf"))
        if not values:
            assert all(r[c] is None for c in points)
            continue
        assert [r[c] for c in points] == pytest.approx(list(np.quantile(np.array(values, float), list(points.values()))), rel=1e-12)
    for g, r in got.items():
        values = [v for h, v in rows if h == g and v is not None]
        assert (r.q0, r.q100) == ((min(values), max(values)) if values else (None, None))


def test_every_rank(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-9, 9)]) for _ in range(300)]
    rows = spark.createDataFrame([(0, v) for v in values], "g int, k long")
    wanted = spark.createDataFrame([(0, i) for i in range(300)], "g int, rank long")
    got = {r["rank"]: r.value for r in selection.at_ranks(rows, ["g"], "k", wanted).collect()}
    assert [got[i] for i in range(300)] == sorted(values)


def test_quantiles_of_nothing_and_of_all(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "v int")
    assert tuple(selection.quantiles(df, "v", {"a": 0.5, "b": 0.33}).first()) == (5.0, pytest.approx(3.3))
    assert selection.quantiles(df.limit(0), "v", {"a": 0.5}, ["v"]).count() == 0


@pytest.mark.parametrize("train,keys", [(0.9, range(1003)), (0.5, [1] * 700 + list(range(301))), (0.333, [None] * 50), (0.0, range(5)), (1.0, range(5)), (0.7, [])])
def test_exact_split(spark, train, keys):
    keys = list(keys)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").repartition(4)
    got = selection.exact_split(df, "k", train)
    assert got.columns == ["k", "i", "split"]
    rows = got.collect()
    assert sorted(r.i for r in rows) == list(range(len(keys)))
    assert sum(r.split == "train" for r in rows) == int(len(keys) * train)
    if len(set(keys)) == len(keys) > 100:
        again = {r.i: r.split for r in selection.exact_split(df.repartition(9), "k", train).collect()}
        assert again == {r.i: r.split for r in rows}
        other = selection.exact_split(df, "k", train, 7).where("split = 'train'").join(got.where("split = 'train'"), "i").count()
        assert other < int(len(keys) * train)


def test_no_percentile_plan(spark):
    df = spark.range(1000).select(F.col("id").alias("v"))
    plan = selection.quantiles(df, "v", {"a": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
