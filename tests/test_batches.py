"""What is worked on in steps of a batch gives what whole batches give, and holds less."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from tarnwell.functions import batches, metrics

R = random.Random(5)
WORDS = [f"w{i}" for i in range(300)]
LISTS = [pa.array([None if R.random() < 0.05 else [R.choice(WORDS) for _ in range(R.randrange(60))] for _ in range(4000)], pa.list_(pa.string())) for _ in range(2)]


def test_steps_are_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(batches, "STEP_BYTES", 2000)
    at = 0
    for start, n in batches.steps(LISTS):
        assert start == at and (n == 1 or sum(c.slice(start, n).nbytes for c in LISTS) <= 2000)
        at += n
    assert at == 4000 and not list(batches.steps([pa.array([], pa.string())]))


@pytest.mark.parametrize("udf", [metrics.lcs_length, metrics.meteor])
def test_steps_change_no_result(monkeypatch, udf):
    full = [pa.array([x or [] for x in c.to_pylist()], pa.list_(pa.string())) for c in LISTS]
    whole = udf.func(*full)
    monkeypatch.setattr(batches, "STEP_BYTES", 3000)
    assert udf.func(*full).equals(whole)
    assert len(udf.func(*[c.slice(0, 0) for c in full])) == 0


def test_a_large_batch_takes_little_more_than_itself():
    big = [pa.concat_arrays([c] * 10) for c in LISTS]
    tracemalloc.start()
    metrics.lcs_length.func(*big)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20, peak


def test_answers_go_out_in_steps(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tarnwell.functions.adapters import ModelConfig, answered

    rows, taken = spark.createDataFrame([(1, "a")], "i long, t string"), []
    with monkeypatch.context() as patch:
        patch.setattr(type(rows), "mapInArrow", lambda self, work, schema: taken.append(work) or self)
        answered(rows, ModelConfig("echo"), F.col("t"), F.lit("p"))
    texts = [f"{i} " + "x" * 10_000 for i in range(2000)]
    batch = pa.record_batch([pa.array(range(2000), pa.int64()), pa.array(texts), pa.array(texts), pa.array(["p"] * 2000), pa.array([True] * 2000)], names=["i", "t", "_ruling", "_prompt", "_asked"])
    made = list(taken[0](iter([batch])))
    assert max(b.num_rows for b in made) < 200
    assert [x for b in made for x in b.column(0).to_pylist()] == list(range(2000))
    assert [x[-600:] for b in made for x in b.column(2).to_pylist()] == [t[:600] for t in texts]


def test_the_tagger_looks_at_each_word_once():
    from tarnwell.plans import text_queries

    text_queries._plain_token.cache_clear()
    found = text_queries.plain_tagger("Der Hund, 12 Hunde: x_1 der ÄRGER! hund hund")
    assert [(x.text, x.stop, x.pos) for x in found] == [("der", True, "NOUN"), ("hund", False, "NOUN"), ("hunde", False, "NOUN"), ("x_", False, "X"), ("der", True, "NOUN"), ("ärger", False, "X"), ("hund", False, "NOUN"), ("hund", False, "NOUN")]
    assert text_queries._plain_token.cache_info().misses == 5


def test_meteor_of_a_step_is_that_of_each_pair_and_stems_each_word_once():
    forms = [a + b for a in ("run", "relat", "hop", "a", "cat", "controll") for b in ("", "s", "ing", "ed", "ional", "ful", "fulness", "ies")]
    sides = [pa.array([None if R.random() < 0.05 else [R.choice(forms) for _ in range(R.randrange(R.choice([2, 9, 70])))] for _ in range(1500)], pa.list_(pa.string())) for _ in range(2)]
    plain = [metrics.meteor_score(a, b) if a and b else 0.0 for a, b in zip(*[c.to_pylist() for c in sides])]
    assert metrics.meteor.func(*sides).to_pylist() == plain
    assert metrics.meteor.func(*[c.slice(40, 300) for c in sides]).to_pylist() == plain[40:340]
    calls = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(metrics, "porter", lambda w, cut=metrics.porter: calls.append(w) or cut(w))
        metrics.meteor.func(*sides)
    assert len(calls) <= len(forms) * 2  # a word's stem is asked for once a step
