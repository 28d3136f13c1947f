"""JSON lists cut by many tasks, against Python's json module."""

from __future__ import annotations

import json
import random

import pytest

from tarnwell.sources import json_lists, tables


def in_blocks(spark, size, read):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return read()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind > 4:
        return {rng.choice(["a", "}", '"', "x\\"]): value(rng, depth + 1) for _ in range(rng.randrange(3))}
    return rng.choice([1, None, True, "", "}{", '"}', "a\\", '\\"}', "[{]", "line\nbreak", "é\U0001f600"])


def record(rng, i):
    return {"i": i, **{rng.choice("bcd"): value(rng) for _ in range(3)}}


@pytest.mark.parametrize("size,files", [(60, 4), (100_000, 40)])
def test_records_equal_the_json_module(spark, tmp_path, size, files):
    rng, want, n = random.Random(7), [], 0
    for k in range(files):
        rows = [record(rng, n + i) for i in range(rng.randrange(12))]
        n += len(rows)
        want += rows
        style = k % 4
        text = json.dumps(rows, ensure_ascii=False) if style == 0 else json.dumps(rows, indent=2) if style == 1 else "\n".join(map(json.dumps, rows)) if style == 2 else "  [\n" + " ,\n".join(map(json.dumps, rows)) + "\n]\n"
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
    (tmp_path / "note.json").write_text("no list {of} records")
    (tmp_path / "open.json").write_text('[{"i": -1}, {"i": -2, "b": {')
    folder = in_blocks(spark, size, lambda: json_lists.json_lines(spark, str(tmp_path)))
    got = [json.loads(r.value) for r in spark.read.text(folder).collect()]
    assert sorted(got, key=lambda r: r["i"]) == [{"i": -1}, *want]


def test_one_list_is_many_tasks(spark, tmp_path):
    rows = [{"i": i, "t": "x } \" {" * (i % 5), "n": {"k": [i, {"m": i}]}} for i in range(40)]
    (tmp_path / "all.json").write_text(json.dumps(rows))  # one line
    pieces = lambda: json_lists.lines_of(spark, str(tmp_path / "all.json"), "}")
    assert in_blocks(spark, 200, lambda: pieces().rdd.getNumPartitions()) > 5
    df = in_blocks(spark, 200, lambda: tables.read_table(spark, str(tmp_path / "all.json")))
    assert {(r.i, r.t, r.n.k[0]) for r in df.selectExpr("i", "t", "n").collect()} == {(r["i"], r["t"], str(r["n"]["k"][0])) for r in rows} and df.count() == 40


@pytest.mark.parametrize("n", [0, 1, 500])
def test_a_written_list_is_one_list(spark, tmp_path, n):
    rows = spark.range(n, numPartitions=7).selectExpr("id AS i", "concat('}{[,', id) AS t").where("i <> 3")
    path = tmp_path / "out.json"
    for _ in range(2):  # the second one takes the first one's place
        tables.save_json(rows, str(path))
    parts = sorted(path.glob("*/part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert {(r["i"], r["t"]) for r in whole} == {(r.i, r.t) for r in rows.collect()} and len(whole) == rows.count()
    assert n < 500 or len(parts) > 5
    if n:
        assert {(r.i, r.t) for r in tables.merge_json(spark, [str(path)]).collect()} == {(r["i"], r["t"]) for r in whole}
