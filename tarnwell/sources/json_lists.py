"""Records of JSON lists, by many tasks a file.

A file is cut at closing braces, whatever its line breaks, and read in the blocks that Spark
cuts files into. What a brace means depends on whether it stands in a string, and a record ends
where the depth is the list's again, so each block is run from both states of a string at once:
a map to the state after it and the change of depth. The maps of a file's blocks are composed
in order; each block is then read once more from the state and depth it begins with. Records
that lie across blocks are put together from their fragments.

A file holds a list of records, a part of one (as `save_json` writes them), or records one after
the other (one a line, or a single one). A file that begins otherwise has none. A record that never ends is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources.quoted import _runs, lines_of, stitched
from tarnwell.sources.scratch import scratch, settled

_STRING = re.compile(r'"(?:[^"\\]|\\.)*("|\\?\Z)', re.S)
_MAP = pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("down_outside", pa.int64()), ("inside", pa.bool_()), ("down_inside", pa.int64()), ("opening", pa.string())])
_CUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("part", pa.string()), ("text", pa.string())])


def bare(piece: str, within: bool) -> tuple[str, bool]:
    """A piece of text with blanks in place of its strings, and whether it ends within one."""
    ends = False

    def blank(m: re.Match) -> str:
        nonlocal ends
        ends = m[1] != '"'
        return " " * len(m[0])

    out = _STRING.sub(blank, '"' + piece if within else piece)
    return (out[1:] if within else out), ends


def after(piece: str, within: bool) -> tuple[bool, int]:
    """State and change of depth after a piece and the brace that ends it."""
    text, ends = bare(piece, within)
    return ends, text.count("{") + text.count("[") - text.count("]") - (not ends)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list] = {}
    for file, block, pieces in _runs(batches):
        state = found.setdefault((file, block), [False, 0, True, 0, None])
        for piece in pieces:
            for k in (0, 2):
                state[k], down = after(piece, state[k])
                state[k + 1] += down
            if state[4] is None and (start := piece.lstrip()):
                state[4] = start[0]
    rows = [(*k, *v) for k, v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MAP)], schema=_MAP)


def starts(pieces: DataFrame) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each block whether it begins within a string, its depth there, and the depth of the file's records; files without records are left out.

    The driver sees a row for each of Spark's input splits, 128 MB each at most.
    """
    maps = pieces.mapInArrow(_maps, "file string, block long, outside boolean, down_outside long, inside boolean, down_inside long, opening string")
    files = maps.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*[f.name for f in _MAP][1:]))).alias("maps"))
    out = {}
    for r in files.toLocalIterator():
        base = {"[": 1, "{": 0, ",": 0}.get(next((m.opening for m in r.maps if m.opening), ""))
        within, depth = False, 0
        for m in r.maps if base is not None else ():
            out[r.file, m.block] = within, depth, base
            depth += m.down_inside if within else m.down_outside
            within = m.inside if within else m.outside
    return out


def _cut(batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], tuple[bool, int, int]]) -> Iterator[pa.RecordBatch]:
    """Whole records of each block, and the fragments at its ends: head, tail, or all of the block."""
    key, held, headed = None, [], False
    within, depth, base = False, 0, 0

    def made(texts: list[str], part: str | None) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([key[0]] * n, [key[1]] * n, [False] * n, [part] * n, texts), _CUT)], schema=_CUT)

    def end() -> Iterator[pa.RecordBatch]:
        if held:
            yield made(["".join(held)], "all" if headed else "tail")

    for file, block, pieces in _runs(batches):
        if (file, block) not in starts:
            continue
        if key != (file, block):
            yield from end()
            key, held = (file, block), []
            within, depth, base = starts[key]
            headed = depth > base
        ready = []
        for piece in pieces:
            begin = 0
            if depth <= base and not within:  # between records: what is before the next brace is the list's
                begin = bare(piece, False)[0].find("{")
            within, down = after(piece, within)
            depth += down
            if begin < 0:
                continue
            held.append(piece[begin:] + "}")
            if depth <= base and not within:
                if headed:
                    yield made(["".join(held)], "head")
                    headed = False
                else:
                    ready.append("".join(held))
                held = []
        if ready:
            yield made(ready, None)
    if key is not None:
        yield from end()


def json_lines(spark: SparkSession, paths: str | list[str]) -> str:
    """A folder with the records of JSON files, one a line, for `spark.read.json`; files that hold no records are skipped."""
    pieces = lines_of(spark, paths, "}", True)
    found = starts(pieces)
    cut = settled(pieces.mapInArrow(lambda batches: _cut(batches, found), "file string, block long, first boolean, part string, text string"))
    # a fragment at the end of a file that no brace closes is no record
    across = stitched(cut.where(F.col("part").isNotNull()), "").select("text").where(F.get_json_object("text", "$").isNotNull())
    path = scratch(spark)
    cut.where(F.col("part").isNull()).select("text").unionByName(across).select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(path)
    return path
