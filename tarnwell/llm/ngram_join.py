"""N-gram Jaccard join by vertical partitioning.

A text's set is its different five-word shingles (or, with fewer words, its whole word
sequence). Sets that are equal are one class. Two classes link when their Jaccard
similarity is min_percent or more; what comes back is each row's component.

1. The n-gram order, by hash, is cut into fragments. Each fragment gets its segment of all
   sets, packed by batch, and finds the n-grams that two classes or more have, with their
   document frequency. N-grams of one class only (most of them) end there: they can't add
   to any overlap. N-grams that are frequent within a batch skip the fragment, which is only
   told of them; they count as most frequent everywhere.
2. Each class gets back its shared n-grams, ordered from rare to frequent. Linked sets share
   an n-gram among the rarest n - ceil(t n) + 1 of each (single ones first), so classes
   whose single n-grams fill that prefix have no partner.
3. Classes that share a prefix n-gram are candidates. To keep a large group of copies from
   becoming all its pairs, each class is first compared with one leader of each of its
   prefix n-grams; then all pairs of different components that share a prefix n-gram, in
   blocks of the n-gram's classes. Pairs within a component can't change the result.
   Before that, classes go for which an n-gram has no partner: the one with the smallest set
   is too large for what is left of their own set from the n-gram on.
4. Candidates are verified fragment by fragment: the order is cut again, each fragment
   counts a pair's partial overlap, and the counts are summed by pair.

N-grams, and classes, are told apart by 64-bit hashes. A fragment is a range of hashes, so
that seven bytes or fewer of an n-gram's hash, beside its fragment, give all 64 bits back.
A batch sends one parcel to each fragment that it has n-grams for; there are never more
parcels than n-grams.

Null and empty texts, and those without a word, have an empty set and link with nothing:
their component is their own id. Rows that repeat a text share its class. Rows with a null
id take part; a component's id is its smallest non-null one. Texts are worked on whole,
extra columns are passed by.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Workspace, arrow, payload, pieces
from tarnwell.llm.components import components

LEAST_FRAGMENTS = 256  # so that the ranges are of 2^56 hashes at most
MIX = np.uint64(0x9E3779B97F4A7C15)
OFTEN = 2**31 - 1  # document frequency of n-grams that are frequent within a batch
MEMO_WORDS = 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted different hashes of a word list's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    last = len(h) - width + 1
    out = h[:last].copy()
    for k in range(1, width):
        out ^= out >> np.uint64(29)
        out *= MIX
        out += h[k : last + k]
    out ^= out >> np.uint64(32)
    out *= MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def narrow(a: np.ndarray) -> bytes:
    """Counts as 8, 16 or 32 bits each, as they fit."""
    most = a.max(initial=0)
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n if n else 1}").astype(np.int64)


def fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of each hash: fragments are equal ranges of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)


def token_bytes(fragments: int) -> int:
    """Low bytes of a hash that tell it from all others of its fragment."""
    return 8 - (fragments.bit_length() - 1) // 8


def pack(hashes: np.ndarray, size: int) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(raw: bytes, size: int, part: int, fragments: int) -> np.ndarray:
    """The hashes of a fragment from their low bytes."""
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    low = out.reshape(-1).view("<u8").astype(np.uint64)
    if size == 8:
        return low
    first = -(-(part << 32) // fragments) << 32  # the smallest hash of the fragment
    base, span = first >> (8 * size) << (8 * size), 1 << (8 * size)
    low += np.uint64(base)
    low[low < np.uint64(first)] += np.uint64(span)
    return low


#: kind 0: a fragment's segments; 1: rows of documents; 2: shared n-grams on their way back, by bucket of classes.
PARCEL = "kind int, part long, keys binary, sizes binary, counts binary, tokens binary, often binary, freqs binary, ids array<bigint>"
PARCEL_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int64()), *[(c, pa.binary()) for c in ("keys", "sizes", "counts", "tokens", "often", "freqs")], ("ids", pa.list_(pa.int64()))])


def parcels(rows: list[tuple]) -> pa.RecordBatch:
    return arrow(dict(zip(PARCEL_ARROW.names, map(list, zip(*rows)))), PARCEL_ARROW)


def segments(docs: DataFrame, fragments: int, width: int, often: int, piece_bytes: int) -> DataFrame:
    """Parcels of kinds 0, 1 and 2 of all documents."""

    size = token_bytes(fragments)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, 1, piece_bytes):
            data, at = payload(batch.column(1))
            raw = data.tobytes()
            row_keys, row_sizes, sets = [], [], {}
            for i in range(batch.num_rows):
                own = shingles(raw[at[i] : at[i + 1]].lower().split(), hashes, width)
                key = xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own)) if len(own) else 0
                row_keys.append(key)
                row_sizes.append(len(own))
                if len(own):
                    sets.setdefault(key, own)
            keys = np.array(row_keys, np.uint64)
            name = uuid.uuid4().int >> 65  # of its own, so that equal batches don't meet in one task
            yield parcels([(1, name, keys.tobytes(), np.array(row_sizes, "<u4").tobytes(), None, None, None, None, batch.column(0).to_pylist())])
            if sets:
                yield parcels(list(segment(np.array(list(sets), np.uint64), list(sets.values()), name)))

    def segment(keys: np.ndarray, sets: list[np.ndarray], name: int) -> Iterator[tuple]:
        sizes = np.array([len(s) for s in sets])
        full = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        by = np.argsort(full, kind="stable")  # by fragment, as fragments are ranges, and by set within an n-gram
        full, owner = full[by], owner[by]
        head = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
        run = np.diff(np.append(head, len(full)))
        frequent = np.repeat(run >= often, run)
        told = full[head][run >= often]
        if frequent.any():
            inner = np.argsort(owner[frequent], kind="stable")
            own, t = owner[frequent][inner], full[frequent][inner]
            count = np.bincount(own, minlength=len(sets))
            have = np.flatnonzero(count)
            yield (2, name, keys[have].tobytes(), narrow(sizes[have]), narrow(count[have]), t.astype("<u8").tobytes(), None, np.full(len(t), OFTEN, "<u4").tobytes(), None)
        own, t = owner[~frequent], full[~frequent]
        p, told_part = fragment_of(t, fragments), fragment_of(told, fragments)
        for k in np.union1d(p, told_part):
            a, b = np.searchsorted(p, [k, k + 1])
            inner = a + np.argsort(own[a:b], kind="stable")
            have, count = np.unique(own[a:b], return_counts=True)
            yield (0, int(k), keys[have].tobytes(), narrow(sizes[have]), narrow(count), pack(t[inner], size), pack(told[told_part == k], size), None, None)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(work, PARCEL)


def shared(parcels_: DataFrame, fragments: int, buckets: int) -> DataFrame:
    """Parcels of kinds 1 and 2: rows of documents, and n-grams of two classes or more by bucket of classes."""
    low = token_bytes(fragments)

    def split(keys, sizes, owner, tokens, freqs) -> list[tuple]:
        """owner: place in keys of each token."""
        rows, part = [], (keys % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(part[owner], kind="stable")
        owner, tokens, freqs = owner[by], tokens[by], freqs[by]
        for k in np.unique(part[owner]):
            a, b = np.searchsorted(part[owner], [k, k + 1])
            have, count = np.unique(owner[a:b], return_counts=True)
            inner = np.argsort(owner[a:b], kind="stable")
            rows.append((2, int(k), keys[have].tobytes(), narrow(sizes[have]), narrow(count), tokens[a:b][inner].astype("<u8").tobytes(), None, freqs[a:b][inner].astype("<u4").tobytes(), None))
        return rows

    def work(group: tuple, table: pa.Table) -> pa.Table:
        kind, part = (x.as_py() for x in group)
        if kind == 1:
            return table
        raw = {c: table.column(c).to_pylist() for c in ("keys", "sizes", "counts", "tokens", "often", "freqs")}
        keys = [np.frombuffer(k, "<u8") for k in raw["keys"]]
        sizes = np.concatenate([wide(s, len(k)) for s, k in zip(raw["sizes"], keys)])
        counts = np.concatenate([wide(c, len(k)) for c, k in zip(raw["counts"], keys)])
        key = np.concatenate(keys)
        owner = np.repeat(np.arange(len(key)), counts)
        if kind == 2:
            tokens, freqs = (np.concatenate([np.frombuffer(x, t) for x in raw[c]]) for c, t in (("tokens", "<u8"), ("freqs", "<u4")))
            rows = split(key, sizes, owner, tokens, freqs)
        else:
            tokens = unpack(b"".join(raw["tokens"]), low, part, fragments)
            told = np.unique(unpack(b"".join(raw["often"]), low, part, fragments))
            # a class may come from several batches
            by = np.lexsort((key[owner], tokens))
            t, k = tokens[by], key[owner][by]
            one = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]) if len(t) else np.zeros(0, bool)
            by, t = by[one], t[one]
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            run = np.diff(np.append(head, len(t)))
            freq = np.where(np.isin(t[head], told), OFTEN, run) if len(t) else run
            kept = np.repeat(freq > 1, run)
            rows = split(key, sizes, owner[by][kept], t[kept], np.repeat(freq, run)[kept])
        return pa.Table.from_batches([parcels(rows)] if rows else [], PARCEL_ARROW)

    return parcels_.groupBy("kind", "part").applyInArrow(work, PARCEL)


def ordered(parcels_: DataFrame, min_percent: int) -> DataFrame:
    """key, n, tokens (shared ones, rare first) and prefix (how many of them candidates come from) of classes that can have a partner."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("prefix", pa.int32())])

    def work(group: tuple, table: pa.Table) -> pa.Table:
        raw = {c: table.column(c).to_pylist() for c in ("keys", "sizes", "counts", "tokens", "freqs")}
        keys = [np.frombuffer(k, "<u8") for k in raw["keys"]]
        sizes = np.concatenate([wide(s, len(k)) for s, k in zip(raw["sizes"], keys)])
        counts = np.concatenate([wide(c, len(k)) for c, k in zip(raw["counts"], keys)])
        key = np.repeat(np.concatenate(keys), counts)
        size = np.repeat(sizes, counts)
        token, freq = (np.concatenate([np.frombuffer(x, t) for x in raw[c]]) for c, t in (("tokens", "<u8"), ("freqs", "<u4")))
        by = np.lexsort((token, freq, key))
        key, size, token = key[by], size[by], token[by].astype(np.int64)
        # the same n-gram may come back from several batches
        one = np.concatenate([[True], (key[1:] != key[:-1]) | (token[1:] != token[:-1])])
        key, size, token = key[one], size[one], token[one]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        have, n = np.diff(np.append(head, len(key))), size[head]
        prefix = n - (min_percent * n + 99) // 100 + 1 - (n - have)
        able = np.flatnonzero(prefix > 0)
        at = np.append(head, len(key))
        return pa.Table.from_batches([arrow({"key": key[head[able]].view(np.int64), "n": n[able], "tokens": [token[at[i] : at[i + 1]] for i in able], "prefix": np.minimum(prefix[able], have[able])}, schema)])

    return parcels_.where("kind = 2").groupBy("part").applyInArrow(work, "key long, n long, tokens array<bigint>, prefix int")


def verified(pairs: DataFrame, classes: DataFrame, min_percent: int, cuts: int) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps by fragment of the order, summed by pair."""
    part = F.transform(F.sequence(F.lit(0), F.lit(cuts - 1)), lambda k: F.struct(k.alias("part"), F.filter("tokens", lambda t: F.pmod(t, F.lit(cuts)) == k).alias("segment")))
    segments_ = classes.select("key", "n", F.explode(part).alias("s")).select("key", "n", "s.part", "s.segment")
    left = segments_.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "part", F.col("segment").alias("s_a"))
    right = segments_.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "part", F.col("segment").alias("s_b"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("o"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("o").alias("o"))
    return summed.where(F.lit(100) * F.col("o") >= F.lit(min_percent) * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b")


def first_ones(classes: DataFrame) -> DataFrame:
    """token, key, n, own (n-grams of the class alone) and at (place in its order) of each prefix n-gram."""
    own = (F.col("n") - F.size("tokens")).alias("own")
    rows = classes.select("key", "n", own, F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("pos", "token"))
    return rows.select("token", "key", "n", "own", (F.col("own") + F.col("pos")).alias("at"))


def candidates(entries: DataFrame, min_percent: int, work: Workspace) -> DataFrame:
    """Each class with the leader of each of its prefix n-grams: the one with the smallest share of n-grams of its own.

    That order is the same for all n-grams, so that a group of copies has few leaders.
    """
    lead = F.struct((F.col("own") / F.col("n")).alias("share"), F.col("key").alias("other"), F.col("n").alias("m"), F.col("at").alias("at2"))
    leaders = entries.groupBy("token").agg(F.min(lead).alias("lead")).select("token", "lead.other", "lead.m", "lead.at2")
    # written first: a join of two exchanges can split a frequent n-gram
    return fitting(entries.join(work.table(leaders, "lead"), "token"), min_percent)


def fitting(rows: DataFrame, min_percent: int) -> DataFrame:
    """Different pairs (a, b) of key and other that can link by their sizes and by where the n-gram stands in each.

    If it is the first that the two share, at most the ones from there on are shared; if it
    is not, the first one brings the pair.
    """
    most = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at2"))
    able = rows.where((F.col("key") != F.col("other")) & (F.lit(100 + min_percent) * most >= F.lit(min_percent) * (F.col("n") + F.col("m"))))
    return able.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def across(entries: DataFrame, roots: DataFrame, min_percent: int, block: int, work: Workspace) -> DataFrame:
    """All pairs of different components that share a prefix n-gram: blocks of its classes against each other.

    Classes that no other class of the n-gram can be a partner of by fitting's rule, as even
    the smallest is too large, are left out before: texts that share a template, but less of
    it than the threshold, make no pairs.
    """
    named = entries.join(roots, entries["key"] == roots["node"], "left").select("token", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    # the largest partner that a class can have by what is left of it from the n-gram on
    named = work.table(named.withColumn("reach", F.floor((F.lit(100 + min_percent) * (F.col("n") - F.col("at"))) / F.lit(min_percent)) - F.col("n")), "named")
    least = named.groupBy("token").agg(F.min("n").alias("least"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    named = named.join(work.table(least.select("token", "least"), "least_n"), "token").where("reach >= least").drop("reach", "least")
    split = named.groupBy("token").agg(F.count("*").alias("c"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    split = work.table(split.select("token", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "split")
    placed = named.join(split, "token")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    first = placed.select("token", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "key", "n", "at", "root")
    second = placed.select("token", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("key").alias("other"), F.col("n").alias("m"), F.col("at").alias("at2"), F.col("root").alias("root2"))
    return fitting(first.join(second, ["token", "i", "j"]).where((F.col("root") != F.col("root2")) & ((F.col("i") != F.col("j")) | (F.col("key") < F.col("other")))), min_percent)


def join(docs: DataFrame, min_percent: int = 80, width: int = 5, fragment_bytes: int = 8 << 20, often: int = 64, block: int = 256, cuts: int = 4, piece_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    fragment_bytes: text by which a fragment of the n-gram order grows; the number of
    fragments follows the input, from LEAST_FRAGMENTS and the number of shuffle partitions on.
    """
    if not 0 < min_percent <= 100:
        raise ValueError(f"min_percent is from 1 to 100, not {min_percent}")
    work = Workspace(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    fragments = min(1 << 22, max(LEAST_FRAGMENTS, partitions, math.ceil(size / fragment_bytes)))
    found = work.table(shared(segments(docs, fragments, width, often, piece_bytes), fragments, max(1, fragments // 2)), "shared")
    rows = work.table(rows_of(found), "rows")
    classes = work.table(ordered(found, min_percent), "classes")
    work.free("shared")
    entries = work.table(first_ones(classes), "entries")
    links = work.table(verified(candidates(entries, min_percent, work), classes, min_percent, cuts), "links")
    roots = components(links)
    more = work.table(verified(across(entries, roots, min_percent, block, work), classes, min_percent, cuts), "more")
    work.free("classes", "entries", "lead", "named", "least_n", "split")
    roots = components(links.union(more))
    work.free("links", "more")
    return labelled(rows, roots)


def rows_of(found: DataFrame) -> DataFrame:
    """doc_id, n_shingles and key (null: empty set) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sizes, ids in zip(*(batch.column(i) for i in range(3))):
                key, n = np.frombuffer(keys.as_py(), "<i8"), np.frombuffer(sizes.as_py(), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(n.astype(np.int64)), pa.array(key, mask=n == 0)], ["doc_id", "n_shingles", "key"])

    return found.where("kind = 1").select("keys", "sizes", "ids").mapInArrow(work, "doc_id long, n_shingles long, key long")


def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of documents with the smallest id of their component."""
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, classes["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(lowest, "root").select("key", "component_id")
    out = rows.join(ids, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
