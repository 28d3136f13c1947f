"""Suffix-array deduplication of long byte strings across all texts.

A byte goes when it is covered by a string of `length` bytes that stands elsewhere too
(keep="none"), or that stands earlier (keep="first": earlier in order of id and place).

Equal strings are brought together by content. Each window of `length` bytes belongs to
its minimizer: the k-byte gram in it with the lowest hash, the leftmost of equals. Equal
windows have equal minimizers at equal places, so a gram that is the minimizer of only one
run of windows settles all of them. The other runs are shipped, each as the few hundred
bytes that its windows cover, and are compared where their grams meet: there the suffixes
at window starts are sorted by prefix doubling, and the longest-previous-factor array, up to
`length` and from the previous and next smaller positions in suffix order, tells which
windows have an earlier equal. Windows whose 64-bit hash occurs once where their gram meets
have none, and are left out before the sort; between those left, factors under `length`
aren't used. Grams with more than `hot` runs would make large groups; their windows are
keyed by the hash of the whole window instead, without factors, and each batch sends one
record for each different window, so that no group exceeds the number of batches.

Equal texts are worked on once, with the number of copies. Texts are told apart by 84
hash bits, windows of hot grams by 128.

Null and empty texts, and those shorter than `length`, lose nothing. Null ids come last in
the order. Rows that repeat id and text count as copies for keep="none"; for keep="first"
all rows that repeat the first copy's id are kept. Extra columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Workspace, arrow, offsets_of, payload, pieces, ragged

#: Windows that one numpy step works on.
STEP = 1 << 19
_SEED = np.random.default_rng(20240229)
_BYTES = [_SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_PLACE = np.uint64((1 << 26) - 1)


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, STEP + 4096)
        base = int(_BASE[which])
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, np.uint64(b))
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _POWERS[which] = tuple(made)
    return tuple(p[:n] for p in _POWERS[which])


def rolling(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the width bytes from each place on."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(which, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[which][data] * up)])
    h = (sums[width:] - sums[:-width]) * down[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the width values from each place on."""
    have, out = 1, a
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(a) - width + 1], out[width - have :][: len(a) - width + 1]) if have < width else out


def anchors_of(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Gram hash, place of the gram, first and last window of each run of windows with one minimizer.

    starts: offsets of the texts in data, with the end. Windows don't cross texts.
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h = rolling(data, k)
    keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(keyed, length - k + 1) & _PLACE).astype(np.int64)
    sizes = np.diff(starts)
    left = np.repeat(starts[1:], sizes) - np.arange(len(data))
    window = np.flatnonzero(left[: len(at)] >= length)
    at = at[window]
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return h[at[first]], at[first], window[first], window[last]


def suffix_order(data: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """starts sorted by the cap bytes from there on (ties by place), their ranks, and the ranks of each doubled width."""
    padded = np.concatenate([data, np.zeros(2 * cap + 8, np.uint8)])
    width = 1
    rank = padded.astype(np.int64)
    levels = [(1, rank)]
    while 2 * width <= cap:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1) if 2 * width > 4 else pair
        if 2 * width == 4:
            rank = np.unique(rank, return_inverse=True)[1].reshape(-1)
        width *= 2
        levels.append((width, rank))
    pair = rank[starts] * (int(rank.max()) + 1) + rank[starts + cap - width]
    order = np.lexsort((starts, pair))
    ranks = np.unique(pair, return_inverse=True)[1].reshape(-1)
    return order, ranks, levels


def smaller_before(places: np.ndarray) -> np.ndarray:
    """For each entry the nearest one on the left with a smaller value (-1: none). Values differ.

    Runs of 2^k entries are stepped over while their minimum is greater, the longest first.
    """
    places = places.astype(np.int32)
    minima = [places]
    while 2 << (len(minima) - 1) <= len(places):
        half = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))  # of the 2 * half values from each entry on
    at = np.arange(len(places)) - 1
    for k in range(len(minima) - 1, -1, -1):
        begin = at - (1 << k) + 1
        over = np.flatnonzero(begin >= 0)
        over = over[minima[k][begin[over]] > places[over]]
        at[over] -= 1 << k
    return at


def longest_previous(data: np.ndarray, cap: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array of the starts (all places), up to cap, and an earlier start with that match (-1: none).

    In suffix order the best earlier match of a start is its previous or its next smaller
    one. Starts ascend. Matches end with the data, not with a text in it.
    """
    starts = np.arange(len(data)) if starts is None else starts
    n = len(starts)
    lpf, source = np.zeros(n, np.int64), np.full(n, -1)
    if n < 2:
        return lpf, source
    order, _, levels = suffix_order(data, starts, cap)
    sorted_ = starts[order]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        for width, rank in reversed(levels):
            for _ in range(2 if width == levels[-1][0] else 1):
                same = (rank[a + got] == rank[b + got]) & (got + width <= cap)
                got += width * same
        return np.minimum(np.minimum(got, cap), len(data) - np.maximum(a, b))

    before = smaller_before(sorted_)
    after = n - 1 - smaller_before(sorted_[::-1])[::-1]
    for other in (before, after):
        has = np.flatnonzero((other >= 0) & (other < n))
        length = common(sorted_[has], sorted_[other[has]])
        better = length > lpf[order[has]]
        lpf[order[has[better]]], source[order[has[better]]] = length[better], sorted_[other[has[better]]]
    return lpf, source


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For window starts, in the order of copies: has an earlier equal (factor of `length` or more); has any equal.

    A window whose hash occurs once has no equal, so its factor is shorter; the factors of the
    others come from the suffixes at their starts and the bytes they cover.
    """
    earlier, some = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    if not len(starts):
        return earlier, some
    h = rolling(data, length)[starts]
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(count[inverse.reshape(-1)] > 1)
    if not len(maybe):
        return earlier, some
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, starts[maybe], 1)
    np.add.at(cover, starts[maybe] + length, -1)
    held = np.cumsum(cover[:-1]) > 0
    moved = (np.cumsum(held) - 1)[starts[maybe]]
    factor, source = longest_previous(data[held], length, moved)
    again = factor >= length
    earlier[maybe] = again
    some[maybe] = again
    some[maybe[np.searchsorted(moved, source[again])]] = True  # equal windows are a chain of sources
    return earlier, some


def keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("key"), F.shiftright(F.crc32(text), 12).cast("int").alias("chk")


# A spot is 20 bits of the text's check sum, 31 bits of a place in the text and 12 bits of a count, in one long.
CHK, START = 43, 12


def spot(chk, start, count):
    return (chk.astype(np.int64) << CHK) | (start.astype(np.int64) << START) | count


def unspot(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check sum, place, count."""
    return spots >> CHK, (spots >> START) & ((1 << (CHK - START)) - 1), spots & ((1 << START) - 1)


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


ANCHOR_ARROW = pa.schema([("key", pa.int64()), ("gram", pa.int64()), ("spot", pa.int64())])


def anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """key, gram and spot (first window; windows after it) of each run of windows; a batch sends equal texts once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, STEP):
            data, at = payload(batch.column(2))
            key, chk = (batch.column(i).to_numpy() for i in (0, 1))
            _, own = np.unique(np.stack([key, chk.astype(np.int64)]), axis=1, return_index=True)
            if len(own) < len(key):
                own = np.sort(own)
                data = np.concatenate([data[at[i] : at[i + 1]] for i in own])
                at = np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[own])])
                key, chk = key[own], chk[own]
            for begin in range(0, max(1, len(data)), STEP):  # a very long text in steps that share length - 1 bytes
                stop = min(len(data), begin + STEP + length - 1)
                cuts = np.unique(np.clip(at, begin, stop)) - begin
                if len(cuts) < 2:
                    continue
                gram, _, first, last = anchors_of(data[begin:stop], cuts, length, k)
                doc = np.searchsorted(at, first + begin, "right") - 1
                yield arrow({"key": key[doc], "gram": gram.view(np.int64), "spot": spot(chk[doc], first + begin - at[doc], last - first)}, ANCHOR_ARROW)

    rows = docs.select(*keys(text_of(docs)), text_of(docs)).where(F.octet_length(text_of(docs)) >= length)
    return rows.mapInArrow(work, "key long, gram long, spot long")


def different_texts(docs: DataFrame) -> DataFrame:
    """key, chk, text (compressed), ord (smallest id) and copies of each different text."""
    schema = pa.schema([("key", pa.int64()), ("chk", pa.int32()), ("o", pa.int64()), ("t", pa.binary())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches, 3, STEP):
            yield arrow({"key": batch.column(0), "chk": batch.column(1), "o": batch.column(2), "t": [compress(t.as_buffer()) for t in batch.column(3)]}, schema)

    rows = docs.select(*keys(text_of(docs)), order_of(docs), text_of(docs).alias("t")).mapInArrow(squeeze, "key long, chk int, o long, t binary")
    return rows.groupBy("key", "chk").agg(F.min("t").alias("text"), F.min("o").alias("ord"), F.count("*").alias("copies"))


def order_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("o")


RECORD = "g long, g2 long, ord long, key long, spot long, piece binary"
RECORD_ARROW = pa.schema([*[(c, pa.int64()) for c in ("g", "g2", "ord", "key", "spot")], ("piece", pa.binary())])
RANGE = "key long, chk int, start long, stop long"
RANGE_ARROW = pa.schema([("key", pa.int64()), ("chk", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])


def spans_of(texts: DataFrame, length: int, keep: str) -> DataFrame:
    """Records to compare: runs of windows with their bytes by gram; windows of hot grams by hash, without bytes.

    The count in a spot is the copies that the record stands for; windows that are settled
    in the batch have no group. texts: key, ord, text and runs (gram, hot, spot).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            key, order, texts_, runs = batch.columns[:4]
            bounds, flat = offsets_of(runs).astype(np.int64), runs.values
            gram, hot, spots = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            wide, held = [], 0
            for i in range(batch.num_rows):
                a, b = bounds[i], bounds[i + 1]
                text = unpack(texts_[i].as_buffer())
                _, first, more = unspot(spots[a:b])
                cold = np.flatnonzero(~hot[a:b])
                if len(cold):
                    n = len(cold)
                    stops = first + more + length
                    yield arrow(
                        {"g": gram[a:b][cold], "g2": np.zeros(n), "ord": np.repeat(order[i].as_py(), n), "key": np.repeat(key[i].as_py(), n), "spot": spots[a:b][cold] >> START << START | 1, "piece": [text[x:y] for x, y in zip(first[cold].tolist(), stops[cold].tolist())]},
                        RECORD_ARROW,
                    )
                data = np.frombuffer(text, np.uint8)
                for j in np.flatnonzero(hot[a:b]):
                    part = data[first[j] : first[j] + more[j] + length]
                    wide.append((rolling(part, length), rolling(part, length, 1), np.arange(first[j], first[j] + more[j] + 1), order[i].as_py(), key[i].as_py(), spots[a + j] >> CHK))
                    held += int(more[j]) + 1
                if held > STEP // 4:
                    yield from heat(wide)
                    wide, held = [], 0
            if wide:
                yield from heat(wide)

    def heat(wide: list) -> Iterator[pa.RecordBatch]:
        sizes = [len(x[0]) for x in wide]
        h, h2, start = (np.concatenate([x[i] for x in wide]) for i in range(3))
        order, key, chk = (np.repeat(np.array([x[i] for x in wide], np.int64), sizes) for i in (3, 4, 5))
        by = np.lexsort((start, chk, key, order, h2, h))
        h, h2, start, order, key, chk = (x[by] for x in (h, h2, start, order, key, chk))
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        count = np.diff(np.append(np.flatnonzero(head), len(h)))
        settled = ~head if keep == "first" else np.repeat(count > 1, count)
        for rows, copies, own in ((np.flatnonzero(settled), None, False), (np.flatnonzero(head), np.minimum(count, 2), True)):
            n = len(rows)
            if n:
                yield arrow(
                    {"g": h[rows].view(np.int64) if own else pa.nulls(n, pa.int64()), "g2": h2[rows].view(np.int64), "ord": order[rows], "key": key[rows], "spot": spot(chk[rows], start[rows], copies if own else 1), "piece": pa.nulls(n, pa.binary())},
                    RECORD_ARROW,
                )

    # copies goes along unused, so that both uses of texts have the same columns
    return texts.select("key", "ord", "text", "runs", "copies").mapInArrow(work, RECORD)


def merge_windows(start: np.ndarray, key: np.ndarray, chk: np.ndarray, length: int) -> pa.RecordBatch:
    """Ranges of bytes that the windows cover, windows next to each other in one range."""
    by = np.lexsort((start, chk, key))
    start, key, chk = start[by], key[by], chk[by]
    new = np.concatenate([[True], (start[1:] > start[:-1] + 1) | (key[1:] != key[:-1]) | (chk[1:] != chk[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return arrow({"key": key[first], "chk": chk[first], "start": start[first], "stop": start[last] + length}, RANGE_ARROW)


def resolve(records: DataFrame, length: int, keep: str, held_bytes: int = 1 << 19) -> DataFrame:
    """Ranges of bytes to remove, from records that are sorted by group and order within their partition."""

    def weights(rows: pa.RecordBatch) -> np.ndarray:
        at = offsets_of(rows.column(5))
        return at[1:] - at[0]

    def cold(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of runs: suffix order and previous factors of the different pieces."""
        table = pa.Table.from_batches(rows)
        codes: dict[bytes, int] = {}
        # rows come in order of copies within a group, and a piece belongs to one group
        which = np.array([codes.setdefault(p, len(codes)) for p in table.column("piece").to_pylist()])
        sizes = np.array([len(p) for p in codes])
        data = np.frombuffer(b"".join(codes), np.uint8)
        heads = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        begin = np.concatenate([[0], np.cumsum(windows)])
        owner = np.repeat(np.arange(len(sizes)), windows)
        earlier, some = repeated_windows(data, ragged(heads, windows), length)
        copies = np.bincount(which, minlength=len(sizes))
        leader = np.zeros(len(which), bool)
        leader[np.unique(which, return_index=True)[1]] = True
        gone = some | (copies[owner] > 1) if keep == "none" else np.ones(len(owner), bool)
        key = table.column("key").to_numpy()
        chk, first, _ = unspot(table.column("spot").to_numpy())
        # a window of the result for each copy of a piece
        each = ragged(begin[:-1][which], windows[which])
        row = np.repeat(np.arange(len(which)), windows[which])
        hit = np.where(leader[row], earlier[each], True) if keep == "first" else gone[each]
        at, row = (each - begin[which][row])[hit], row[hit]
        if len(row):
            yield merge_windows(first[row] + at, key[row], chk[row], length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held, last, pending = 0, None, None
        for batch in batches:
            bare = pc.is_null(batch.column(5))
            settled = batch.filter(pc.is_null(batch.column(0)))
            if settled.num_rows:
                chk, start, _ = unspot(settled.column(4).to_numpy())
                yield merge_windows(start, settled.column(3).to_numpy(), chk, length)
            hot = batch.filter(pc.and_(pc.is_valid(batch.column(0)), bare))
            if hot.num_rows:
                found, last, pending = heated(hot, last, pending)
                if found is not None:
                    yield found
            rows = batch.filter(pc.invert(bare))
            while rows.num_rows:
                g = rows.column(0).to_numpy()
                ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
                room = np.searchsorted(weights(rows), max(0, held_bytes - held))
                stop = int(ends[np.searchsorted(ends, min(room, len(g) - 1), "right")])
                waiting.append(rows.slice(0, stop))
                held += int(weights(rows)[stop - 1])
                rows = rows.slice(stop)
                if rows.num_rows:  # the groups so far are whole; the last one of a batch may go on
                    yield from cold(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from cold(waiting)

    def heated(hot: pa.RecordBatch, last, pending):
        """Windows by hash. The group that was open at the end of a batch may go on in the next."""
        g, g2, key = (hot.column(c).to_numpy() for c in ("g", "g2", "key"))
        chk, start, copies = unspot(hot.column("spot").to_numpy())
        head = np.concatenate([[last != (g[0], g2[0])], (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])])
        if keep == "first":
            gone = ~head
        else:
            alone = head & np.append(head[1:], True)  # the last may be alone yet
            gone = ~alone & (copies < 2)  # those of more copies are settled already
        hit = np.flatnonzero(gone)
        rows = [start[hit], key[hit], chk[hit]]
        if keep == "none" and pending is not None and not head[0]:
            rows = [np.append(a, x) for a, x in zip(rows, pending)]
        pending = (start[-1], key[-1], chk[-1]) if head[-1] and copies[-1] < 2 else None
        return (merge_windows(*rows, length) if len(rows[0]) else None), (g[-1], g2[-1]), pending

    return records.mapInArrow(work, RANGE)


RESULT = "key long, chk int, ord long, copies long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
RESULT_ARROW = pa.schema([("key", pa.int64()), ("chk", pa.int32()), *[(c, pa.int64()) for c in ("ord", "copies", "n_bytes", "n_removed", "n_spans")], ("kept", pa.binary()), ("kept_sha256", pa.string())])
NEW = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]


def cut(text: bytes, starts: list[int], stops: list[int], whole_chars: bool) -> tuple[bytes, int, int]:
    """The bytes left, the number removed and the number of maximal removed runs."""
    cover = np.zeros(len(text) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, stops, -1)
    gone = np.cumsum(cover[:-1]) > 0
    data = np.frombuffer(text, np.uint8)
    if whole_chars:  # a character is removed only with all its bytes
        char = np.cumsum((data & 0xC0) != 0x80)
        kept_char = np.zeros(int(char[-1]) + 1 if len(char) else 1, bool)
        kept_char[char[~gone]] = True
        gone &= ~kept_char[char]
    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return data[~gone].tobytes(), int(gone.sum()), runs


def dedup(docs: DataFrame, length: int = 200, k: int = 64, hot: int = 2048, keep: str = "none", whole_chars: bool = False, texts_back: bool = True) -> DataFrame:
    """All columns of docs with n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of each row's text.

    Columns of docs with those names are replaced. whole_chars: a character goes only with
    all its bytes, so that what is left is UTF-8. texts_back=False leaves kept null, so
    that no text travels back to the rows.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    if not 8 <= k <= length < k + (1 << START):
        raise ValueError("k must be 8 at least, and length from k on, by less than 4096")
    work_tables = Workspace(docs.sparkSession)
    found = work_tables.table(anchors(docs, length, k), "anchors")
    # 1. grams that are minimizers of two runs or more; as a table, so that a join can split a hot one
    shared = found.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram", (F.col("c") > hot).alias("hot"))
    shared = work_tables.table(shared, "shared")
    chk = F.shiftright("spot", CHK).cast("int").alias("chk")
    runs = found.join(shared, "gram").groupBy("key", chk).agg(F.collect_set(F.struct("gram", "hot", "spot")).alias("runs"))
    # 2. the different texts, and the records that their shared runs make
    texts = different_texts(docs)
    records = spans_of(texts.join(runs, ["key", "chk"]), length, keep)
    # settled windows have no group; they stay spread
    spread = F.coalesce(F.col("g"), F.xxhash64("key", "spot"))
    grouped = records.repartition(spread).sortWithinPartitions("g", "g2", "ord", "key", "spot")
    # 3. the ranges to remove, back at their texts
    ranges = resolve(grouped, length, keep).groupBy("key", "chk").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    whole = texts.join(ranges, ["key", "chk"], "left").select("key", "chk", "ord", "copies", "text", "starts", "stops")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches, 4, STEP // 4):
            rows = []
            for key, chk, first, copies, squeezed, starts, stops in zip(*(c.to_pylist() for c in batch.columns)):
                body = unpack(squeezed)
                if keep == "none" and copies > 1 and len(body) >= length:
                    starts, stops = [0], [len(body)]
                left, gone, spans = cut(body, starts, stops, whole_chars) if starts else (body, 0, 0)
                rows.append((key, chk, first, copies, len(body), gone, spans, pack(left) if texts_back else None, hashlib.sha256(left).hexdigest()))
            yield arrow(dict(zip(RESULT_ARROW.names, zip(*rows))), RESULT_ARROW)

    done = whole.mapInArrow(work, RESULT)
    names = [c for c in docs.columns if c not in NEW]
    own = docs.select(F.struct(*names).alias("row"), order_of(docs), *keys(text_of(docs))).join(done, ["key", "chk"])
    later = F.lit(keep == "first") & (F.col("o") != F.col("ord")) & (F.col("n_bytes") >= length)
    empty = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept": F.lit(None).cast("binary"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    out = own.select("row.*", "n_bytes", *[F.when(later, empty[c]).otherwise(F.col(c)).alias(c) for c in NEW[1:]])
    if not texts_back:
        return out
    at = out.columns.index("kept")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts_ = pa.array([open_(t.as_buffer()) if t.is_valid else b"" for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts_)

    return out.mapInArrow(unpack, out.schema)


def digest(docs: DataFrame, **params) -> DataFrame:
    return dedup(docs, texts_back=False, **params).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
