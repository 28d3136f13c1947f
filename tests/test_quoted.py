"""Quoted CSV cut by many tasks, against Python's csv module."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tarnwell.sources import quoted, tables


def by_hand(content: bytes):
    text = io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig", errors="replace", newline="")
    return [r for r in csv.reader(text) if r]


def in_blocks(spark, size, read):
    """What read gives with input splits of so many bytes, so that records lie across many blocks. Work tables are read with the usual ones."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return read()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def texts(seed):
    rng = random.Random(seed)
    signs = ["a", "b", ",", ",", "\n", "\n", '"', '""', "\r\n", "\r", " ", "é", "\U0001f600", "﻿", "x,y", '"q",', ',"', '"\n']
    return "".join(rng.choice(signs) for _ in range(rng.randint(0, 400))).encode()


def compare(spark, folder, contents, size):
    """All records of the files, in no order."""
    folder.mkdir()
    for i, c in enumerate(contents):
        (folder / f"f{i}.csv").write_bytes(c)
    found = in_blocks(spark, size, lambda: quoted.records(spark, str(folder)))
    got = {}
    for r in found.collect():
        got.setdefault(r.file.rpartition("/")[2], []).append((r.first, tuple(r.fields)))
    for i, c in enumerate(contents):
        want = by_hand(c)
        mine = got.get(f"f{i}.csv", [])
        assert sorted(f for _, f in mine) == sorted(map(tuple, want)), c
        assert [f for first, f in mine if first] == list(map(tuple, want[:1])), c
    return found


@pytest.mark.parametrize("size,files", [(9, 2), (40, 8), (100_000, 100)])
def test_records_equal_the_csv_module(spark, tmp_path, size, files):
    compare(spark, tmp_path / "csv", [texts(k) for k in range(files)], size)


def test_planted_records(spark, tmp_path):
    long = '"' + "line\n" * 100 + 'end ""quoted"" here"'
    contents = [f"﻿id,t\n1,{long}\n2,plain\n3,\"a\nb\",more\n{long},{long}\nlast".encode(), b'id,t\n1,"never closed\n2,x\n3,y', b"", b"\n\n\n", b'a"b,c"d\n"x"y,z\n', b"\xff\xfe,bad\n", b'"only header"', '﻿1,"open and é\n\n'.encode(), b'x\n"open']
    found = compare(spark, tmp_path / "csv", contents, 50)
    assert found.select("file").distinct().count() == 7
    lines = lambda: quoted.lines_of(spark, str(tmp_path / "csv" / "f0.csv"))
    assert in_blocks(spark, 50, lambda: lines().rdd.getNumPartitions()) > 10  # several tasks for one file
    assert len(in_blocks(spark, 50, lambda: quoted.states(lines())[0])) > 10


def test_state_of_a_line(spark):
    for line in ['a"b', '"a', '"a"', '"a""', '"a"",', 'x,"', '"a"b"c', '"a"b,"c', '"a"\r"b', "", '"', '""', '"""', '","']:
        for state in (False, True):
            read = next(csv.reader(io.StringIO(('"' if state else "") + line + "\nZ", newline="")))
            reader = csv.reader(io.StringIO(('"' if state else "") + line + "\nZ", newline=""))
            rows = list(reader)
            assert quoted.quoted_after(line, state) == (rows[-1] != ["Z"]), (line, state, read)


def test_too_long_records_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "MOST_BYTES", 300)
    (tmp_path / "a.csv").write_text('id,t\n1,"' + "line\n" * 100 + '"\n2,x\n', encoding="utf-8")
    got = in_blocks(spark, 50, lambda: tables.read_arity(spark, str(tmp_path / "a.csv")))
    assert [(r.id, r.t) for r in got.collect()] == [("2", "x")]


def test_arity_and_tolerance(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"a\n\n,b"\n2\n3,c,d\n\n4,"d"\n5,NA\n', encoding="utf-8")
    rows = lambda df: sorted((r.id, r.t) for r in df.collect())
    assert rows(in_blocks(spark, 16, lambda: tables.read_arity(spark, str(tmp_path / "a.csv")))) == [("1", "a\n\n,b"), ("4", "d"), ("5", None)]
    assert rows(in_blocks(spark, 16, lambda: tables.read_tolerant(spark, str(tmp_path / "a.csv")))) == [("1", "a\n\n,b"), ("2", None), ("4", "d"), ("5", None)]
    assert quoted.records(spark, str(tmp_path / "a.csv")).where(F.col("first")).count() == 1


def test_files_of_lines_are_written_by_many_tasks_each_with_the_header(spark, tmp_path):
    from pyspark.sql import functions as F

    from tarnwell.plans import io_queries
    from tarnwell.plans.registry import Tables
    from tarnwell.sources import tables

    def lines(n):
        rows = spark.range(n, numPartitions=5).select("id")
        return io_queries._lines(Tables(spark, str(tmp_path)), "x.csv", F.concat_ws(",", "id", F.lit('"a\nb"')), rows, "k,v")

    path = lines(1000)
    files = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    assert len(files) == 5 and all(f.startswith("k,v\n") and f.count("k,v") == 1 for f in files)
    got = tables.read_arity(spark, path).collect()
    assert sorted(int(r.k) for r in got) == list(range(1000)) and {r.v for r in got} == {"a\nb"}
    assert tables.read_arity(spark, lines(0)).columns == ["k", "v"] and tables.read_arity(spark, lines(0)).count() == 0
