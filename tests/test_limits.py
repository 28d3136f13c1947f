"""Usage and waits of a stream of calls against those of the same calls as a table."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest

from tarnwell.operators import rolling
from tarnwell.streaming import limits

SCHEMA = "i long, ts timestamp, n double, g string"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    before = spark.conf.get(limits.STORE[0])
    spark.conf.set(*limits.STORE)
    yield spark
    spark.conf.set(limits.STORE[0], before)


def calls(n, groups, seed, span=600):
    rng = random.Random(seed)
    times = sorted(START + datetime.timedelta(seconds=rng.choice([rng.randrange(span), rng.random() * span])) for _ in range(n))
    return [(None if i % 50 == 0 else i // 2, at, rng.choice([0.0, 1.0, 2.5, 7.0, None]), rng.choice(groups)) for i, at in enumerate(times)]


def in_files(rows, parts):
    """The rows in order, the calls of one moment together."""
    cuts, out = [len(rows) * k // parts for k in range(parts + 1)], []
    for k in range(1, parts):
        while cuts[k] < len(rows) and rows[cuts[k]][1] == rows[cuts[k] - 1][1]:
            cuts[k] += 1
    for a, b in zip(cuts, cuts[1:]):
        out.append(rows[a:b])
    return out


def run(spark, folder, out, mark, group, files=1):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    found = limits.live(stream, ["i", "ts"], "ts", "n", 20, group)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(240)


def key(r):
    return (r.i is None, r.i or 0, r.ts or START, r.requests, -1 if r.tokens is None else r.tokens, r.wait_seconds)


@pytest.mark.parametrize("groups", [["a", "b", None], None])
def test_a_replayed_stream_is_the_table(store, tmp_path, groups):
    """Stopped after a part of the files, the stream goes on from its checkpoint."""
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows, group = calls(240, groups or ["a"], 3), "g" if groups else None
    parts = in_files(rows, 3)
    for k, part in enumerate(parts):
        store.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if k:
            run(store, folder, out, mark, group)
    table = store.createDataFrame(rows, SCHEMA)
    used = {(r.ts, r.g): (r.requests, r.tokens) for r in rolling.usage(table, "ts", {"tokens": "n"}, group).collect()}
    want = [(r.i, r.ts, *used[r.ts, r.g], r.wait_seconds) for r in rolling.waits(table, "ts", "n", 20, group).collect()]
    got = [tuple(r) for r in sorted(store.read.parquet(out).collect(), key=key)]
    by = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], -1 if r[3] is None else r[3], r[4])
    assert len(got) == len(rows) and any(r[4] for r in want)
    for g, w in zip(sorted(got, key=by), sorted(want, key=by)):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=1e-6)


def test_moments_leave_the_state(store, tmp_path):
    """What no call can look back at any more is taken out."""
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for k in range(4):
        at = START + datetime.timedelta(hours=k)
        store.createDataFrame([(j, at + datetime.timedelta(seconds=j), 1.0, "a") for j in range(30)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run(store, folder, str(tmp_path / "out"), mark, "g")
    held = store.read.format("statestore").option("path", mark).option("stateVarName", "queue").load()
    assert 0 < held.count() <= 30
    assert store.read.parquet(str(tmp_path / "out")).count() == 120


def test_answers_by_hand():
    second = 1_000_000
    found = limits.answers(np.array([0, 30, 60, 61]) * second, np.array([1, 2, 1, 1]), np.array([1, 0, 1, 1]), np.array([5.0, 0.0, 8.0, 3.0]), 10, 60 * second)
    assert found.requests.tolist() == [1, 3, 4, 4] and found.tokens.tolist() == [5, 5, 13, 11]
    # at 60 s three tokens must expire: those of 0 s do at once; at 61 s one must, and the first are those of 60 s
    assert found.wait_seconds.tolist() == [0, 0, 0, 59]
    assert np.isnan(limits.answers(np.array([0]), np.array([1]), np.array([0]), np.array([0.0]), 10, second).tokens[0])
