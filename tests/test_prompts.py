"""Prompt synthesis, repair, stand-ins and settings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.adapters import ModelConfig, normalised
from tarnwell.operators import prompts
from tarnwell.sources import config


def test_synthesize_resumes(spark):
    rows = spark.createDataFrame([(i, f"Ein langes Urteil Nummer {i}.", "Presse", None if i < 4 else "xx API-Fehler") for i in range(6)], "n long, judgement string, summary string, p string")
    done = spark.createDataFrame([(0, "done 0"), (1, "API-Fehler"), (5, "later")], "n long, p string")
    got = {r.n: r.p for r in prompts.synthesize(rows, "n", "judgement", "summary", "p", ModelConfig("echo"), done, 2).collect()}
    assert got[0] == "done 0" and got[1] is None
    assert all(got[i].endswith(f"Urteil Nummer {i}.") for i in range(2, 6))


def test_sanitized_counts(spark):
    df = spark.createDataFrame([(1, "Here is the prompt: Write it well"), (2, "Write it well"), (3, None)], "i int, p string")
    out, counts = prompts.sanitized(df, "p")
    assert {r.i: r.p for r in out.collect()} == {1: "Write it well", 2: "Write it well", 3: None}
    assert tuple(counts.first()) == (1, 2)


def test_repaired(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,t\n1,a\n2,b\n")
    (tmp_path / "bad.csv").write_text("id,t\n1,a\n2,b,c\n3,d\n")
    assert prompts.repaired(spark, str(tmp_path / "good.csv")).count() == 2
    assert sorted(r.id for r in prompts.repaired(spark, str(tmp_path / "bad.csv")).collect()) == ["1", "3"]
    assert prompts.repaired(spark, str(tmp_path / "good.csv"), True).columns == ["id", "t"]
    nothing = prompts.repaired(spark, str(tmp_path / "none.csv"))
    assert nothing.count() == 0 and "synthetic_prompt" in nothing.columns


def test_columns_and_training_rows(spark):
    df = spark.createDataFrame([(i, f"r{i}", "p", "s", "train" if i % 2 else "test") for i in range(200)], "id long, ruling string, p string, s string, split_name string")
    assert prompts.ordered_columns(df, ["s", "none", "id"]).columns == ["s", "id", "ruling", "p", "split_name"]
    mocked = prompts.mock_columns(df, "id", ["m1", "s"])
    assert mocked.where("length(m1) < 300 or length(m1) > 600").count() == 0 and mocked.select("m1").distinct().count() == 200
    assert mocked.where("s <> 's'").count() == 0
    assert {r.split: r["count"] for r in prompts.training_rows(df, "id", "p", "ruling", "s", split="split_name").groupBy("split").count().collect()} == {"train": 100, "test": 100}
    assert 160 <= prompts.training_rows(df, "id", "p", "ruling", "s").where("split = 'train'").count() <= 195
    assert prompts.training_rows(df, "id", "p", "ruling", "s").orderBy("id").first().prompt == "User: p\n\nGerichtsurteil: r0\n\nAssistant: "


def test_normalised(spark):
    df = spark.createDataFrame([("Die Richter und 12 Ärzte gehen x_y",), (None,)], "t string")
    assert [r.n for r in df.select(normalised(F.col("t")).alias("n")).collect()] == ["richter ärzte gehen", ""]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"chunking": {"chunk_size": 512}, "columns": {"text": "body"}}')
    s = config.load(str(tmp_path / "c.json"), {"summarization": {"word_ratio": 0.5, "num_attempts": None}})
    assert (s.chunking.chunk_size, s.columns.text, s.summarization.word_ratio, s.summarization.num_attempts) == (512, "body", 0.5, 3)
    assert config.Settings().chunking.chunk_size == 2048
    for wrong in ({"nothing": {}}, {"chunking": {"x": 1}}, {"chunking": {"chunk_size": 0}}, {"summarization": {"max_summary_length": 9999}}):
        with pytest.raises(ValueError):
            config.load(None, wrong)
