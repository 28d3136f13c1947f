"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: a shard holds the postings of some megabytes of
text, as sorted term hashes, the range of postings of each term, and the postings
themselves (ascending positions; one place is left free between documents, so no phrase
crosses them). Shards are rows of a written table, so searching doesn't touch the texts
again and a lost executor loses nothing.

A phrase is searched from its rarest term in the shard: its postings, shifted by its place
in the phrase, are the candidate starts; the lists of the other terms, rarest first, cut
them down. With slop > 0 the other terms may stand that many words off (a proximity match),
within the same document; one word of a text may serve several equal ones of a phrase. A
greater slop never finds less.

Phrases go to the executors in blocks of block_bytes of benchmark text. Blocks are searched
one after the other, each by a scan of the index, and the driver holds one at a time; the
hits of several blocks are written, and merged by shard and place in it. A shard has a name
of its own, so shards of equal content stay apart. Terms are told apart by 64-bit hashes.

Null and empty texts have no words and no hits. Benchmark rows with null id or without
words are left out; rows that share an id are one item. Repeated documents give repeated
results; a text longer than a shard's size is a shard of its own; other columns are passed by.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Workspace, arrow, payload, pieces
from tarnwell.llm.rules import Ids

#: A-Z to a-z; bytes that no word holds to a blank.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD = pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("starts", pa.binary()), ("positions", pa.binary())])
SHARD_SQL = "shard string, doc_ids array<bigint>, n_words array<int>, terms binary, starts binary, positions binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def build_index(docs: DataFrame, shard_bytes: int = 4 << 20) -> DataFrame:
    """The shards of all documents, in a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, shard_bytes):
            data, at = payload(batch.column(1))
            raw, ids, numbers, counts = data.tobytes(), Ids(), [], []
            for i in range(batch.num_rows):
                words = words_of(raw[at[i] : at[i + 1]])
                counts.append(len(words))
                numbers.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            counts = np.array(counts, np.int64)
            terms = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
            by_hash = np.argsort(terms)
            rank = np.empty(len(ids), np.int32)
            rank[by_hash] = np.arange(len(ids), dtype=np.int32)
            ranked = rank[np.concatenate(numbers)]
            places = np.arange(len(ranked)) + np.repeat(np.arange(len(counts)), counts)
            starts = np.concatenate([[0], np.cumsum(np.bincount(ranked, minlength=len(ids)))])
            positions = places[np.argsort(ranked, kind="stable")].astype("<i4").tobytes()
            yield arrow(
                {"shard": [uuid.uuid4().hex], "doc_ids": [batch.column(0).to_pylist()], "n_words": [counts], "terms": [terms[by_hash].astype("<u8").tobytes()], "starts": [starts.astype("<i4").tobytes()], "positions": [positions]},
                SHARD,
            )

    shards = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SHARD_SQL)
    return Workspace(docs.sparkSession).table(shards, "postings")


@dataclass
class Phrases:
    """Windows of test terms, and the items that have each."""

    terms: np.ndarray  # different term hashes
    windows: np.ndarray  # [window, place] -> row of terms, -1 after the end
    items: list[list[str]]


def phrases_of(rows: list[tuple[str, bytes]], window: int) -> Phrases:
    """All windows of each text; a shorter text is one window."""
    ids, found = Ids(), {}
    for item, text in rows:
        words = [ids[w] for w in words_of(text)]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item)
    table = np.full((len(found), window), -1)
    for k, phrase in enumerate(found):
        table[k, : len(phrase)] = phrase
    return Phrases(np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids)), table, [sorted(x) for x in found.values()])


def matches(phrases: Phrases, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, heads: np.ndarray, slop: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(window, starts of its occurrences in the shard, their documents, its length) of each window that occurs. heads: first position of each document."""
    if not len(terms) or not len(phrases.windows):
        return
    row = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    known = terms[row] == phrases.terms
    count = np.where(known, starts[row + 1] - starts[row], 0).astype(np.int64)
    filled = phrases.windows >= 0
    many = np.where(filled, count[phrases.windows], np.iinfo(np.int64).max)
    for w in np.flatnonzero(many.min(1) > 0):
        length = int(filled[w].sum())
        order = np.argsort(many[w, :length], kind="stable")
        first = None
        for place in order:
            t = row[phrases.windows[w, place]]
            postings = positions[starts[t] : starts[t + 1]].astype(np.int64)
            if first is None:
                first, doc = postings - place, np.searchsorted(heads, postings, "right")
                continue
            # not before the match's own document, where a posting could hide the right one
            near = np.searchsorted(postings, np.maximum(first + place - slop, heads[doc - 1]))
            inside = near < len(postings)
            first, near, doc = first[inside], near[inside], doc[inside]
            inside = (postings[near] <= first + place + slop) & (np.searchsorted(heads, postings[near], "right") == doc)
            first, doc = first[inside], doc[inside]
            if not len(first):
                break
        if len(first):
            yield int(w), first, doc - 1, length


HITS = "shard string, place int, doc_id long, n_words long, spans array<struct<first:int,last:int>>, items array<string>"
HITS_ARROW = pa.schema([("shard", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])


def search(index: DataFrame, phrases: Phrases, slop: int = 0, all_rows: bool = True) -> DataFrame:
    """For each document (all_rows) or each with a hit: spans of words (first, last) in occurrences of the phrases, merged, and the items found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, doc_ids, n_words, terms, starts, positions = (c[k] for c in batch.columns)
                doc_ids, counts = doc_ids.as_py(), np.array(n_words.as_py(), np.int64)
                heads = np.concatenate([[0], np.cumsum(counts + 1)])  # one free place after each document
                cover, items = np.zeros(heads[-1] + 1, np.int32), {}
                buffers = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((terms, "<u8"), (starts, "<i4"), (positions, "<i4")))
                for w, at, doc, length in matches(phrases, *buffers, heads, slop):
                    np.add.at(cover, np.maximum(at, heads[doc]), 1)
                    np.add.at(cover, np.minimum(at + length, heads[doc + 1] - 1), -1)
                    for d in set(doc.tolist()):
                        items.setdefault(d, set()).update(phrases.items[w])
                hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]]).astype(np.int8)
                begins, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
                owner = np.searchsorted(heads, begins, "right") - 1
                spans: dict[int, list] = {}
                for d, b, e in zip(owner.tolist(), (begins - heads[owner]).tolist(), (ends - heads[owner]).tolist()):
                    spans.setdefault(d, []).append({"first": b, "last": e - 1})
                rows = list(range(len(doc_ids))) if all_rows else sorted(spans)
                yield arrow(
                    {"shard": [shard.as_py()] * len(rows), "place": rows, "doc_id": [doc_ids[d] for d in rows], "n_words": counts[rows], "spans": [spans.get(d, []) for d in rows], "items": [sorted(items.get(d, ())) for d in rows]},
                    HITS_ARROW,
                )

    return index.mapInArrow(work, HITS)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, spans of hit words and items (sorted ids as text) of each document."""
    index = build_index(docs)
    tests = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    if blocks > 1:  # written, as each block is a scan of it
        tests = Workspace(docs.sparkSession).table(tests, "tests")
    hits = None
    for k in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        phrases = phrases_of(sorted((r["item"], r["text"].encode()) for r in part.toLocalIterator()), window)
        if blocks == 1:
            return search(index, phrases, slop)
        more = Workspace(docs.sparkSession).table(search(index, phrases, slop, all_rows=False), f"hits{k}")
        hits = more if hits is None else hits.union(more)
    merged = hits.groupBy("shard", "place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grown = F.expr("""aggregate(s, cast(array() as array<struct<first:int,last:int>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).last >= x.first - 1,
           concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))),
           concat(a, array(x))))""")
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d")).select("shard", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    found = rows.join(merged.select("shard", "place", grown.alias("spans"), "items"), ["shard", "place"], "left")
    filled = {"spans": "array<struct<first:int,last:int>>", "items": "array<string>"}
    return found.select("shard", "place", "doc_id", "n_words", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in filled.items()])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of what find gives."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
