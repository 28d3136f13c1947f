"""Model calls: every row comes back once, every different request is called once, runs go on where they stopped."""

from __future__ import annotations

import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import adapters
from tarnwell.functions.adapters import REGISTRY, ModelConfig
from tarnwell.operators import evaluation, prompts
from tarnwell.operators.ledger import Ledger, request_digest
from tarnwell.sources import tables

ROWS = [("a", "r1", "p"), ("a", "r2", "p"), (None, "r3", "p"), ("b", "r1", "p"), (None, "r3", "p"), ("c", None, None), ("d", "", "p"), ("e", "r1p", "")]


def counting_kind():
    """A class of its own, which goes to executors by value, as they can't import tests."""

    class Counting:
        """Leaves a file for each call in a folder; requests with `bad` fail as often as told."""

        def __init__(self, config):
            self.folder, self.fails = config.options["folder"], config.options.get("fails", 0)

        def generate(self, ruling, prompt):
            said = f"{ruling}|{prompt}"
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(said)
            if "bad" in said and sum(open(f"{self.folder}/{x}").read() == said for x in os.listdir(self.folder)) <= self.fails:
                raise ValueError("no answer")
            return f"<{said}>"

    return Counting


@pytest.fixture
def counting(tmp_path):
    (tmp_path / "calls").mkdir()
    REGISTRY["counting"] = counting_kind()
    yield lambda **more: ModelConfig("m", "counting", {"folder": str(tmp_path / "calls"), **more}, pause=0.001)
    del REGISTRY["counting"]


def calls(config):
    return Counter(open(f"{config.options['folder']}/{x}").read() for x in os.listdir(config.options["folder"]))


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id string, ruling string, prompt string").repartition(3).withColumn("reference", F.concat(F.lit("ref "), "ruling"))


@pytest.mark.parametrize("parallel", [1, 4])
def test_every_row_comes_back_once(spark, counting, parallel):
    config = counting()
    config.parallel = parallel
    got = adapters.run_generation(table(spark), [config], "id", "ruling", "prompt", "reference").collect()
    assert Counter((r.id, r.generated_press) for r in got) == Counter((i, f"<{r or ''}|{p or ''}>") for i, r, p in ROWS)
    assert all(r.reference_press == f"ref {r.generated_press[1:].split('|')[0]}" for r in got if r.id not in ("c",))


def test_a_kind_of_the_driver_runs_on_executors_and_unknown_ones_fail_here(spark, counting):
    assert adapters.generate(table(spark), counting(), "id", "ruling", "prompt").where("generated IS NULL").count() == 0
    with pytest.raises(ValueError, match="Unknown model type"):
        adapters.generate(table(spark), ModelConfig("x", "nowhere"), "id", "ruling", "prompt")
    with pytest.raises(ValueError, match="there already"):
        adapters.answered(table(spark).withColumn("error", F.lit(1)), counting(), F.col("ruling"), F.col("prompt"))


def test_failed_calls_wait_and_are_tried_again(spark, counting):
    import time

    rows = table(spark, [("x", "bad", "p")])
    config = counting(fails=2)
    config.pause = 0.2
    began = time.time()
    assert adapters.generate(rows, config, "id", "ruling", "prompt").first().generated == "<bad|p>"
    assert time.time() - began > 0.5 and calls(config)["bad|p"] == 3
    failed = adapters.run_generation(table(spark, [("x", "bad worse", "p")]), [counting(fails=9)], "id", "ruling", "prompt", "reference").first()
    assert (failed.generated_press, failed.error, failed.reference_press) == ("", "no answer", "ref bad worse")


def test_ledger_calls_each_request_once(spark, counting, tmp_path):
    config, ledger = counting(), Ledger(spark, str(tmp_path / "ledger"), every=2)
    rows = table(spark)
    want = Counter((i, r, f"<{r or ''}|{p or ''}>") for i, r, p in ROWS)
    made = ledger.ask(rows, config, F.col("ruling"), F.col("prompt"))
    # the result is used for two files and a count, and all is asked again by another session's ledger
    tables.write_generation(made.withColumn("model", F.lit("m")), str(tmp_path / "out"))
    assert made.count() == len(ROWS) and Counter((r.id, r.ruling, r.generated) for r in made.collect()) == want
    again = Ledger(spark, str(tmp_path / "ledger")).ask(rows, config, F.col("ruling"), F.col("prompt"))
    assert Counter((r.id, r.ruling, r.generated) for r in again.collect()) == want
    assert calls(config) == Counter({f"{r or ''}|{p or ''}" for _, r, p in ROWS})
    # other options are another model
    other = counting(temperature=1)
    assert ledger.ask(rows, other, F.col("ruling"), F.col("prompt")).where("generated IS NOT NULL").count() == len(ROWS)
    assert set(calls(other).values()) == {2}


def test_ledger_tries_failed_calls_in_the_next_run(spark, counting, tmp_path):
    config, ledger = counting(fails=4), Ledger(spark, str(tmp_path / "ledger"))
    rows = table(spark, [(None, "bad", "p"), (None, "bad", "p"), ("y", "good", "p")])
    ask = lambda: Counter((r.id, r.generated, r.error) for r in ledger.ask(rows, config, F.col("ruling"), F.col("prompt")).collect())
    assert ask() == {(None, None, "no answer"): 2, ("y", "<good|p>", None): 1}
    assert ask() == {(None, "<bad|p>", None): 2, ("y", "<good|p>", None): 1}
    assert calls(config) == {"bad|p": 5, "good|p": 1}
    assert ledger.ask(rows.limit(0), config, F.col("ruling"), F.col("prompt")).count() == 0


def test_ledger_goes_on_where_it_was_stopped(spark, counting, tmp_path):
    config, folder = counting(), str(tmp_path / "ledger")
    rows = table(spark, [(str(i), f"r{i}", "p") for i in range(60)])
    seen = []

    class Stopped(Ledger):
        def calls(self):
            seen.append(1)
            return super().calls()

    # as if the process had ended after some waves: their rows are there, the others are not
    Ledger(spark, folder).ask(rows.where("id < '3'"), config, F.col("ruling"), F.col("prompt"))
    assert Stopped(spark, folder, every=7).ask(rows, config, F.col("ruling"), F.col("prompt")).where("generated IS NULL").count() == 0
    assert set(calls(config).values()) == {1} and len(calls(config)) == 60 and seen


def test_digests_tell_requests_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc"), ("abc", "")], "r string, p string")
    digest = request_digest(ModelConfig("m"), F.col("r"), F.col("p"))
    assert rows.select(digest.alias("d")).distinct().count() == 4
    assert rows.select(request_digest(ModelConfig("n"), F.col("r"), F.col("p")).alias("d")).join(rows.select(digest.alias("d")), "d").count() == 0


def test_synthesize_keeps_null_and_repeated_ids(spark, counting, tmp_path):
    rows = spark.createDataFrame([(None, "u0", "p0", None), (None, "u1", "p1", "kept"), (1, "u2", "p2", None), (1, "u2", "p2", None), (7, "u3", "p3", "API-Fehler")], "n long, judgement string, summary string, p string")
    done = spark.createDataFrame([(1, "done"), (1, "done")], "n long, p string")
    for ask in (adapters.answered, Ledger(spark, str(tmp_path / "ledger")).ask):
        got = prompts.synthesize(rows, "n", "judgement", "summary", "p", counting(), done, 5, ask)
        assert got.columns == rows.columns
        found = Counter((r.n, r.judgement, r.p[:4]) for r in got.collect())
        assert found == {(None, "u0", "<u0|"): 1, (None, "u1", "kept"): 1, (1, "u2", "done"): 2, (7, "u3", "<u3|"): 1}


def test_evaluation_run_keeps_all_rows_and_scores_each_once(spark, tmp_path):
    numbers = [0, 1, 2, 2, 17, -4, None, None]
    wide = spark.createDataFrame([(n, f"text number {k}", f"text {k}") for k, n in enumerate(numbers)], "row long, press string, m1 string").withColumn("m2", F.col("m1"))
    folder = str(tmp_path / "run")
    part = evaluation.run(wide, "row", "press", ["m1"], folder, 5, steps=1).first()
    assert part.total_samples == 2
    for every in (5, 100):
        got = {r.model: r.total_samples for r in evaluation.run(wide, "row", "press", ["m1", "m2"], folder, every).collect()}
        assert got == {"m1": 8, "m2": 8}
    written = spark.read.parquet(folder)
    assert written.count() == 16 and written.where("model = 'm1'").select("generated").distinct().count() == 8
    assert evaluation.run(wide.limit(0), "row", "press", ["m1"], str(tmp_path / "none"), 5).count() == 0


def test_evaluation_run_deals_a_step_to_many_tasks(spark, tmp_path):
    """One file with all rows in order of their numbers: no task scores many more of a step's rows than another."""
    wide = spark.range(0, 400, numPartitions=1).select(F.col("id").alias("row"), F.lit("a text of words").alias("press"), F.lit("a text").alias("m1"))
    folder = str(tmp_path / "dealt")
    evaluation.run(wide, "row", "press", ["m1"], folder, 200, steps=1)
    shares = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()]
    assert sum(shares) == 200 and len(shares) >= 8 and max(shares) <= 200 // 8


def test_steps_tell_of_rows_outside(spark, tmp_path):
    rows = spark.createDataFrame([(0,), (None,), (9,)], "n long")
    with pytest.raises(ValueError, match="2 rows are in no step"):
        tables.run_in_steps(rows, "n", [5], lambda df: df, str(tmp_path))


def test_evaluate_with_models_calls_each_once(spark, tmp_path):
    folder = str(tmp_path / "judged")
    os.makedirs(folder)

    def judge(source, generated, reference):
        @F.udf("string")
        def call(text):
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return '{"klarheit": {"wert": 3}}'

        return call(generated)

    wide = spark.createDataFrame([(i, f"text {i}", f"text {i}") for i in range(5)], "row long, press string, m1 string")
    scored, summed = evaluation.evaluate(wide, "row", "press", ["m1"], source="press", adapters=evaluation.Adapters(judge=judge))
    made = len(os.listdir(folder))
    assert scored.count() == 5 and summed.first().total_samples == 5 and len(scored.collect()) == 5
    assert len(os.listdir(folder)) == made


def test_a_model_reads_its_own_calls_and_known_requests_move_no_texts(spark, tmp_path, monkeypatch):
    from tarnwell.operators import ledger as module

    rows = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "i int, t string")
    calls = module.Ledger(spark, f"{tmp_path}/calls")
    calls.ask(rows, ModelConfig("a"), F.col("t"), F.lit("p"))
    calls.ask(rows, ModelConfig("b"), F.col("t"), F.lit("p"))
    assert calls.answers("a").count() == 5 and calls.answers().count() == calls.calls().count() == 10
    plans, own = [], module.settled
    monkeypatch.setattr(module, "settled", lambda df, *rest: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df, *rest))
    again = calls.ask(rows, ModelConfig("a"), F.col("t"), F.lit("p"))
    assert again.count() == 20 and calls.calls().count() == 10
    # the digests that are open, and nothing of the texts
    assert len(plans) == 2 and "Join" not in plans[1]
