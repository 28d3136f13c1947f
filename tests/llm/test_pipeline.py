"""The pipeline on planted documents, stage by stage and as a whole."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwell.llm import bpe, queries

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The labelled documents of sf0.1 and added ones: copies, near copies, leaks, repeated passages, toxic and clean ones."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    folder = str(tmp_path_factory.mktemp("sf"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    text, passage = say(200), say(80)
    near = text.split(" ")
    near[100] = "changed"
    rows = {
        900001: text, 900002: text, 900003: " ".join(near),
        900011: say(60) + " " + passage + " " + say(60), 900012: say(70) + " " + passage + " " + say(50),
        900021: say(50) + " " + item + " " + say(50),
        900031: say(20) + " idiot " + say(3) + " scum moron worthless " + say(20),
        900041: say(120), 900042: say(15),
    }
    extra = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows.items()] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder, rows, passage


def test_stages(spark, planted):
    folder, rows, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        kept[name] = {r.doc_id: r.text for r in docs.where("doc_id > 900000 or doc_id is null").collect()}
    assert 900031 not in kept["toxicity"] and set(rows) - {900031} <= set(kept["toxicity"])
    assert 900001 in kept["ngram_join"] and not {900002, 900003} & set(kept["ngram_join"])
    cut = kept["suffix_dedup"]
    assert cut[900011] == rows[900011] and passage not in cut[900012] and rows[900012].startswith(cut[900012][:100])
    assert 900021 not in kept["decontam"]
    assert {900001, 900011, 900012, 900041, 900042, None} <= set(kept["decontam"])
    assert kept["decontam"][900041] == rows[900041]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    own = bpe.tokenizer(queries.TOKENIZER)
    ids = {r.doc_id: r for r in last}
    want = own.encode(rows[900041])
    assert ids[900041].ids_sha256 == hashlib.sha256(want).hexdigest() and ids[900041].n_tokens == len(np.frombuffer(want, "<u4"))
    whole = {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {tuple(r) for r in last}


def test_rows_are_dropped_by_row(spark, tmp_path):
    rng = random.Random(2)
    say = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    leak, a, b, c, d = (say() for _ in range(5))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    rows = [(None, "x " + leak, "s"), (7, leak, "s"), (7, a, "s"), (8, b, None), (8, b, None), (None, c, "s"), (None, None, None)]
    clean = corpus_pipeline.decontaminate(spark, frame(rows), str(tmp_path))
    assert clean.columns == ["doc_id", "text", "source"]
    assert left(clean) == sorted([(7, a), (8, b), (8, b), (None, c), (None, None)], key=str)
    rows = [(5, a, "s"), (None, a, "s"), (3, a + " more", "s"), (3, b, "s"), (8, c, None), (8, c, None), (None, d, "s"), (None, d, "s"), (None, None, None), (None, None, None)]
    alone = corpus_pipeline.near_duplicates(spark, frame(rows), str(tmp_path))
    assert left(alone) == sorted([(3, a + " more"), (3, b), (8, c), (None, d), (None, None), (None, None)], key=str)


def test_extra_columns_keep_their_values(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = say(60)
    names = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "key", "chk", "ord", "copies", "o", "runs", "row", "component_id", "score"]
    rows = [(1, say(5) + passage), (2, passage + say(5)), (3, None), (None, say(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(777 + i) for i, c in enumerate(names)}).withColumn("n_chars", F.lit(5)).repartition(2)
    out = corpus_pipeline.repeats(spark, df, "")
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert all(r[c] == 777 + i for r in got.values() for i, c in enumerate(names))
    assert got[1].text == rows[0][1] and passage not in got[2].text and got[2].n_chars == len(got[2].text)
    assert got[3].text is None and got[3].n_chars == 5 and got[None].text == rows[3][1]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in names if n.startswith("op")] == [f.__name__ for f in (queries.op1_quality, queries.op2_langid, queries.op3_ngram_join, queries.op4_rules, queries.op5_urls, queries.op6_toxicity, queries.op7_warc, queries.op8_decontam, queries.op9_bpe, queries.op10_suffix_dedup, queries.op11_fim, queries.op12_branch_merge, queries.op13_html_text)]
    assert set(__spark_entry__.oracle_sql()) <= set(names)
