"""Records of quoted CSV files, by many tasks a file.

A line break may stand in quotes, so where a record ends depends on all that comes before.
Lines are read in the blocks that Spark cuts files into. Whatever the state before it, a line
leaves the reader either between two records or within quotes; so each block is run from both
states at once, which gives a map of two states to two. The maps of a file's blocks are
composed in order, and each block is then read once more from the state it begins in. Records
that lie within a block are parsed there; of those that don't, the fragments are put together
by record.

What a quote means is as in Python's csv module: it opens at the start of a field only, two
are one, and after a closing one the field goes on without quotes up to the next comma. A
carriage return outside of quotes ends a record too. Quotes that never close run to the end of
their file. Records of more than MOST_BYTES are left out.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.sources.scratch import settled

#: Bytes of a record at most; a field of Python's csv module can't be larger.
MOST_BYTES = 1 << 30
#: Lines that are parsed at a time.
LINES = 10_000
_MARK = "\ufeff".encode()
_NEXT_FIELD = re.compile(r"[,\r]")
_RECORD = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("fields", pa.list_(pa.string())), ("part", pa.string()), ("text", pa.string())])


def quoted_after(line: str, quoted: bool) -> bool:
    """Whether the reader is within quotes after a line, by its state before."""
    at, fresh = 0, not quoted
    while True:
        if fresh:
            quoted = line.startswith('"', at)
            at += quoted
        while quoted:
            at = line.find('"', at) + 1
            if not at:
                return True
            quoted = line.startswith('"', at)
            at += quoted
        step = _NEXT_FIELD.search(line, at)
        if not step:
            return False
        at, fresh = step.end(), True


def lines_of(spark: SparkSession, path: str | list[str], sep: str = "\n", deep: bool = False) -> DataFrame:
    """file, block (its start), line (bytes) and the file's size, of text files, in order within each task. deep: with those of folders in folders. A byte order mark at a file's start is no text."""
    rows = spark.read.options(lineSep=sep, recursiveFileLookup=deep).text(path)
    about = [F.col(f"_metadata.{k}").alias(c) for k, c in (("file_path", "file"), ("file_block_start", "block"))]
    return rows.select(*about, F.col("value").cast("binary").alias("line"), F.col("_metadata.file_size").alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Lines of one block at a time, a block's in one or more lists."""
    for batch in batches:
        files, blocks, lines = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield files[start], blocks[start], [x.decode("utf-8", "surrogateescape") for x in lines[start:i]]
                start = i


_MAP = pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("over", pa.int64())])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block whether it ends within quotes if it begins outside, or inside; and how many bytes it has with a break after each line."""
    found: dict[tuple[str, int], list] = {}
    for file, block, lines in _runs(batches):
        state = found.setdefault((file, block), [False, True, 0])
        for line in lines:
            if '"' in line:
                state[:2] = [quoted_after(line, s) for s in state[:2]] if state[0] != state[1] else [quoted_after(line, state[0])] * 2
            state[2] += len(line.encode("utf-8", "surrogateescape")) + 1
    rows = [(*k, *v) for k, v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MAP)], schema=_MAP)


def states(lines: DataFrame) -> tuple[set[tuple[str, int]], set[str]]:
    """The blocks that begin within quotes, and the files whose last record is open and ends in a break.

    A file has a block for each of Spark's input splits, so the driver sees a number for each 128 MB at most.
    """
    maps = lines.mapInArrow(_maps, "file string, block long, outside boolean, inside boolean, over long")
    sizes = lines.groupBy("file").agg(F.max("size").alias("size"))
    start = F.struct(F.lit(False).alias("state"), F.array().cast("array<bigint>").alias("found"))

    def follow(a, m):
        return F.struct(F.when(a["state"], m["inside"]).otherwise(m["outside"]).alias("state"), F.when(a["state"], F.array_append(a["found"], m["block"])).otherwise(a["found"]).alias("found"))

    files = maps.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "outside", "inside"))).alias("maps"), F.sum("over").alias("over"))
    files = files.select("file", "over", F.aggregate("maps", start, follow).alias("end")).where(F.col("end.state") | (F.size("end.found") > 0))
    within, broken = set(), set()
    for r in files.join(sizes, "file").select("file", "end", (F.col("over") - F.col("size")).alias("more")).toLocalIterator():
        within |= {(r.file, b) for b in r.end.found}
        if r.end.state and r.more in (0, -len(_MARK)):  # without a last break the lines have one byte more; the mark was left out
            broken.add(r.file)
    return within, broken


def _parsed(text: str) -> list[list[str]]:
    csv.field_size_limit(MOST_BYTES)
    text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")  # bytes that are no text
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def _cut(batches: Iterator[pa.RecordBatch], within: set[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """Records of each block as fields, and the fragments at its ends as texts: head, tail, or all of the block."""
    key: tuple[str, int] | None = None
    held: list[str] = []
    quoted = headed = first = False

    def made(fields: list[list[str] | None], part: str | None, text: str | None) -> pa.RecordBatch:
        nonlocal first
        n = len(fields)
        values = [[key[0]] * n, [key[1]] * n, [first and i == 0 for i in range(n)], fields, [part] * n, [text] * n]
        first = False
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _RECORD)], schema=_RECORD)

    def rows(records: list[list[str]]) -> pa.RecordBatch:
        return made(records, None, None)

    def fragment(part: str, lines: list[str]) -> pa.RecordBatch:
        return made([None], part, "\n".join(lines).encode("utf-8", "surrogateescape").decode("utf-8", "replace"))

    def end() -> Iterator[pa.RecordBatch]:
        if held:
            yield fragment("all" if headed else "tail", held)

    for file, block, lines in _runs(batches):
        if key != (file, block):
            yield from end()
            key, held, quoted, first = (file, block), [], (file, block) in within, block == 0
            headed = quoted
        ends = []  # lines that end a record
        for i, line in enumerate(lines):
            if '"' in line:
                quoted = quoted_after(line, quoted)
            if not quoted:
                ends.append(i + 1)
        if headed and ends:
            yield fragment("head", held + lines[: ends[0]])
            held, headed, lines, ends = [], False, lines[ends[0] :], [e - ends[0] for e in ends[1:]]
        if ends:
            found = _parsed("\n".join(held + lines[: ends[-1]]) + "\n")
            for i in range(0, len(found), LINES):
                yield rows(found[i : i + LINES])
            held, lines = [], lines[ends[-1] :]
        held += lines
    if key is not None:
        yield from end()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, first, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            records = _parsed(text)
            n = len(records)
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([first and i == 0 for i in range(n)], pa.bool_()), pa.array(records, pa.list_(pa.string()))], names=["file", "first", "fields"])


def stitched(pieces: DataFrame, sep: str) -> DataFrame:
    """file, first, last (whether it is its file's last fragment) and text of each record that lies across blocks.

    A tail begins a record, all fragments up to the next tail belong to it; texts stay out of the window.
    """
    order = F.struct("block", (F.col("part") == "tail").alias("tail"))
    which = pieces.select("file", "block", "part", "first", F.octet_length("text").cast("long").alias("size"))
    number = F.sum((F.col("part") == "tail").cast("long")).over(Window.partitionBy("file").orderBy(order))
    which = which.withColumn("number", number)
    sizes = which.groupBy("file", "number").agg(F.sum("size").alias("bytes"), F.max("first").alias("first"))
    sizes = sizes.withColumn("last", F.col("number") == F.max("number").over(Window.partitionBy("file"))).where(F.col("bytes") <= MOST_BYTES)
    whole = pieces.select("file", "block", "part", "text").join(which.select("file", "block", "part", "number"), ["file", "block", "part"]).join(sizes, ["file", "number"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (F.col("part") == "tail").alias("tail"), "text"))), lambda x: x["text"]), sep)
    return whole.groupBy("file", "number", "last").agg(F.max("first").alias("first"), text.alias("text"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, first (whether it begins its file, as a header does) and fields (texts) of each record that isn't empty.

    Files are read twice, once for the states and once for the records, which are written to
    scratch: the blocks must be the same both times.
    """
    lines = lines_of(spark, path)
    within, broken = states(lines)
    cut = settled(lines.mapInArrow(lambda batches: _cut(batches, within), "file string, block long, first boolean, fields array<string>, part string, text string"))
    whole = stitched(cut.where(F.col("part").isNotNull()), "\n")
    whole = whole.select("file", "first", F.when(F.col("last") & F.col("file").isin(sorted(broken)), F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))
    joined = whole.mapInArrow(_joined, "file string, first boolean, fields array<string>")
    return cut.where(F.col("part").isNull()).select("file", "first", "fields").unionByName(joined)
