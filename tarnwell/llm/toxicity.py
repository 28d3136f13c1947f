"""Toxicity: a factorization machine over hashed terms.

Terms are a text's lower-cased words and their first letters (prefix_chars), hashed to
2^hash_bits places; a term that is there twice or more has a second place. The machine has
a weight and a short vector for each place; the score is the logistic of bias + weights +
products of vectors of all pairs of terms that meet in a text, so that two words can weigh
more together than each does alone.

All places are in the model. As in a lasso with an active set, a place's weight and vector
are zero as long as what the machine has not explained yet is no clearer than chance on it:
clear_alone standard deviations of the loss's slope for a place by itself; for a place
together with another one, so that terms which tell in company only take part as well, a
Chernoff bound as small as clear_pair standard deviations'. Places are looked at anew after
each fit, alone and then in pairs, up to `rounds` times. All pairs are looked at, rare and
frequent: telling_pairs rules out by bounds that no pair can pass.

Learning takes at most max_rows labelled rows (lowest hash of the id), and no more of them
than have max_entries places in all; both bound what the driver holds. Null and empty texts
have no term and get the bias; with no labelled row each score is 0.5. Ids with several
labels count by their mean (ties: toxic). Repeated rows give repeated results, other
columns are passed by, texts are worked on whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Workspace, arrow, payload
from tarnwell.llm.quality import labelled

_words = regex.compile(r"[^\W\d_]+").findall
#: Words whose places a worker remembers.
MEMO_WORDS = 200_000
#: Entries that one numpy step of learning works on.
STEP = 1 << 19


def places_of(word: str, hash_bits: int, prefix_chars: int) -> tuple[int, ...]:
    mask = (1 << hash_bits) - 1
    whole = xxhash.xxh3_64_intdigest(word) & mask
    return (whole, xxhash.xxh3_64_intdigest("^" + word[:prefix_chars]) & mask) if len(word) > prefix_chars else (whole,)


def again(place: int, hash_bits: int) -> int:
    """The second place of a term."""
    return (place * 0x9E3779B1 + 0x7F4A7C15) & ((1 << hash_bits) - 1)


def places_in(text: str | None, hash_bits: int, prefix_chars: int) -> list[int]:
    """All places of a text, in order."""
    counts: Counter[int] = Counter()
    for word, c in Counter(_words(text.lower())).items() if text else ():
        for p in places_of(word, hash_bits, prefix_chars):
            counts[p] += c
    return sorted({*counts, *(again(p, hash_bits) for p, c in counts.items() if c > 1)})


@dataclass
class Machine:
    """place -> row of weights and vectors; the bias; how terms are made."""

    rows: dict[int, int]
    weights: np.ndarray
    vectors: np.ndarray
    bias: float
    hash_bits: int
    prefix_chars: int

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        """Scores of the texts, one after the other."""
        memo: dict[str, tuple[int, ...]] = {}
        owners, found, rows, bits = [], [], self.rows, self.hash_bits
        n = 0
        for n, text in enumerate(texts, 1):
            counts: dict[int, int] = {}
            for word in _words(text.lower()) if text else ():
                known = memo.get(word)
                if known is None:
                    known = tuple(p for p in places_of(word, bits, self.prefix_chars) if p in rows or again(p, bits) in rows)
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = known
                for p in known:
                    counts[p] = counts.get(p, 0) + 1
            if counts:
                own = {rows[p] for q, c in counts.items() for p in ((q, again(q, bits)) if c > 1 else (q,)) if p in rows}
                found.extend(sorted(own))
                owners.extend([n - 1] * len(own))
        return self.logistic(np.array(found, np.int64), np.array(owners, np.int64), n)

    def logistic(self, found: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-_margin(self.weights, self.vectors, self.bias, found, owners, n)[0]))


def _margin(weights, vectors, bias, found, owners, n):
    total = np.stack([np.bincount(owners, vectors[found, k], n) for k in range(vectors.shape[1])], 1) if len(found) else np.zeros((n, vectors.shape[1]))
    squares = np.bincount(owners, (vectors[found] ** 2).sum(1), n) if len(found) else np.zeros(n)
    linear = np.bincount(owners, weights[found], n) if len(found) else np.zeros(n)
    return bias + linear + 0.5 * ((total**2).sum(1) - squares), total


def slopes(owners: np.ndarray, places: np.ndarray, error: np.ndarray, spread: np.ndarray, size: int) -> np.ndarray:
    """For each place the error's sum over the rows that have it, in standard deviations."""
    total, variance = np.zeros(size), np.zeros(size)
    for a in range(0, len(places), STEP):  # so that the entries are never copied whole
        p, own = places[a : a + STEP], owners[a : a + STEP]
        total += np.bincount(p, error[own], size)
        variance += np.bincount(p, spread[own], size)
    return total / np.sqrt(np.maximum(variance, 1e-9))


def surprise(k: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far k of n rows are beyond the q that were expected: the exponent of Chernoff's bound on that chance; 0 for no more than expected."""
    rest = n - k
    far = k * np.log(np.maximum(k, 1e-300) / q) + rest * np.log(np.maximum(rest, 1e-300) / np.maximum(n - q, 1e-300))
    return np.where(k > q, far, 0.0)


def _after(positions: np.ndarray, ends: np.ndarray, columns: np.ndarray, weight: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries from each position up to its end: how many there are of each column from first on, and the sum of their weights."""
    count, total = np.zeros(width), np.zeros(width)
    lengths = ends - positions
    at = np.cumsum(lengths)
    cuts = np.unique(np.searchsorted(at, np.arange(0, at[-1] + STEP, STEP) if len(at) else [], "left"))
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        n = lengths[a:b]
        if not (size := int(n.sum())):
            continue
        step = np.arange(size) + np.repeat(positions[a:b] - np.cumsum(n) + n, n)
        found = columns[step] - first
        count += np.bincount(found, minlength=width)
        total += np.bincount(found, np.repeat(weight[a:b], n), width)
    return count, total


def telling_pairs(owners: np.ndarray, places: np.ndarray, one: np.ndarray, q: np.ndarray, known: np.ndarray, usable: np.ndarray, clear: float) -> np.ndarray:
    """The places that are, with some other place, in more rows of the class `one` than q, the rows' chances of it, allow. owners ascend.

    All pairs of usable places are looked at but those of two known ones. Only sums that can't be passed rule out:
    a pair's surprise is at most the sum of -log(q) of its rows of the class, so at most that
    of either place; and rows of the other class only lower it. So pairs are counted in the
    rows of the class first, then in ever more of the others, as long as any is left.
    """
    size, beyond, loss = len(usable), clear**2 / 2, np.where(one, -np.log(q), 0.0)
    most = sum(np.bincount(places[a : a + STEP], loss[owners[a : a + STEP]], size) for a in range(0, len(places), STEP))
    having = sum(np.bincount(places[a : a + STEP], minlength=size) for a in range(0, len(places), STEP))
    chosen = np.flatnonzero(usable & (most > beyond))
    chosen, width = chosen[np.argsort(having[chosen], kind="stable")], len(chosen)  # rare ones first: they have few rows
    told = np.zeros(size, bool)
    if width < 2:
        return told
    column = np.full(size, -1, np.int32)
    column[chosen] = np.arange(width)
    entries = np.concatenate([a + np.flatnonzero(column[places[a : a + STEP]] >= 0) for a in range(0, len(places), STEP)])
    keys = np.sort(owners[entries].astype(np.int64) * width + column[places[entries]])
    own, columns = (keys // width).astype(np.int32), (keys % width).astype(np.int32)
    del entries, keys
    by_column = np.argsort(columns, kind="stable").astype(np.int32)
    starts = np.searchsorted(columns[by_column], np.arange(width + 1))
    row_ends = np.searchsorted(own, np.arange(1, len(one) + 1))
    old = known[chosen]
    for a in range(width - 1):
        at = by_column[starts[a] : starts[a + 1]].astype(np.int64)
        rows = own[at]
        inside, others = np.flatnonzero(one[rows]), np.flatnonzero(~one[rows])
        count = lambda part: _after(at[part] + 1, row_ends[rows[part]], columns, q[rows[part]], a + 1, width - a - 1)  # noqa: B023, E731
        k, expected = count(inside)
        left = np.flatnonzero((k > expected) & ~(old[a] & old[a + 1 :]))
        left = left[surprise(k[left], k[left], expected[left]) > beyond]
        k, n, expected = k[left], k[left].copy(), expected[left]
        done = 0
        while len(left) and done < len(others):
            last = max(2 * done, len(others) // 8, 64)
            more, likely = count(others[done:last])
            n, expected, done = n + more[left], expected + likely[left], last
            still = surprise(k, n, expected) > beyond
            left, k, n, expected = left[still], k[still], n[still], expected[still]
        if len(left):
            told[chosen[a]] = True
            told[chosen[a + 1 + left]] = True
    return told


def fit(owners: np.ndarray, places: np.ndarray, y: np.ndarray, hash_bits: int = 20, prefix_chars: int = 4, clear_alone: float = 4.0, clear_pair: float = 6.5, least_rows: int = 3, rounds: int = 2, **params) -> Machine:
    """owners, places: one entry for each row of y and place that it has, by row. Places of fewer than least_rows rows tell nothing."""
    n, size, factors = len(y), 1 << hash_bits, params.get("factors", 4)
    machine = Machine({}, np.zeros(0), np.zeros((0, factors)), 0.0, hash_bits, prefix_chars)
    if not n:
        return machine
    share = (y.sum() + 0.5) / (n + 1)
    machine.bias = float(np.log(share / (1 - share)))
    if y.min() == y.max() or not len(places):
        return machine
    usable = sum(np.bincount(places[a : a + STEP], minlength=size) for a in range(0, len(places), STEP)) >= least_rows
    active, p = np.zeros(size, bool), np.full(n, share)

    def alone() -> np.ndarray:
        return (np.abs(slopes(owners, places, y - p, p * (1 - p), size)) > clear_alone) & usable

    def together() -> np.ndarray:
        chance = np.clip(p, 1e-9, 1 - 1e-9)
        found = [telling_pairs(owners, places, y == value, chance if value else 1 - chance, active, usable, clear_pair) for value in (1, 0)]
        return found[0] | found[1]

    for _ in range(rounds):
        before = active.sum()
        for look in (alone, together):
            new = look() & ~active
            if not new.any():
                continue
            active |= new
            kept = np.flatnonzero(active)
            entries = np.concatenate([a + np.flatnonzero(active[places[a : a + STEP]]) for a in range(0, len(places), STEP)])
            own, found = owners[entries].astype(np.int64), np.searchsorted(kept, places[entries])
            machine = descend(own, found, y, kept, machine, **params)
            p = machine.logistic(found, own, n)
        if active.sum() == before:
            break
    return machine


def descend(owners: np.ndarray, found: np.ndarray, y: np.ndarray, kept: np.ndarray, before: Machine, factors: int = 4, epochs: int = 40, batches: int = 10, rate: float = 0.3, ridge: float = 1e-3) -> Machine:
    """A machine of the kept places by AdaGrad on the logistic loss, in `batches` parts of the rows. found: rows of kept; owners ascend."""
    n, share = len(y), (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(7)
    place = rng.permutation(n)
    order = np.argsort(place[owners], kind="stable")
    owners, found = place[owners][order], found[order]
    y = y[np.argsort(place)]
    parts = []
    for first, last in zip(range(0, n, -(-n // batches)), [*range(0, n, -(-n // batches))[1:], n]):
        a, b = np.searchsorted(owners, [first, last])
        own = owners[a:b] - first
        has = np.unique(own)
        parts.append((y[first:last], own, found[a:b], has, np.searchsorted(own, has)))
    weights, vectors, bias = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), factors)), float(np.log(share / (1 - share)))
    sums = [np.full(a.shape, 1e-6) for a in (weights, vectors, np.zeros(1))]
    for _ in range(epochs):
        for labels, own, places, has, starts in parts:
            own_vectors, margin, total = vectors[places], np.full(len(labels), bias), np.zeros((len(labels), factors))
            if len(starts):
                total[has] = np.add.reduceat(own_vectors, starts)
                margin[has] += np.add.reduceat(weights[places] - 0.5 * (own_vectors**2).sum(1), starts) + 0.5 * (total[has] ** 2).sum(1)
            error = (1 / (1 + np.exp(-margin)) - labels) / len(labels)
            e = error[own]
            others = total[own] - own_vectors
            steps = (
                np.bincount(places, e, len(kept)) + ridge * weights / n,
                np.stack([np.bincount(places, e * others[:, k], len(kept)) for k in range(factors)], 1) + ridge * vectors / n,
                np.array([error.sum()]),
            )
            for s, g in zip(sums, steps):
                s += g**2
            weights = weights - rate * steps[0] / np.sqrt(sums[0])
            vectors = vectors - rate * 0.3 * steps[1] / np.sqrt(sums[1])
            bias -= rate * float(steps[2][0] / np.sqrt(sums[2][0]))
    return Machine({int(p): i for i, p in enumerate(kept)}, weights, vectors, bias, before.hash_bits, before.prefix_chars)


def train(docs: DataFrame, labels: DataFrame, teaches: Column, max_rows: int = 20_000, max_entries: int = 10_000_000, hash_bits: int = 20, prefix_chars: int = 4, **params) -> Machine:
    """A machine from the labelled rows for which `teaches` (a condition on doc_id) holds.

    The driver gets the distinct places of the rows, four bytes a place: rows in the order
    of their ids' hash as long as their places are no more than max_entries.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            got = [np.array(places_in(t, hash_bits, prefix_chars), "<u4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], ["doc_id", "y", "x"])

    rows = labelled(docs, labels, "toxic", teaches, max_rows).select("doc_id", "text", "y").mapInArrow(work, "doc_id long, y int, x binary")
    rows = Workspace(docs.sparkSession).table(rows.withColumn("h", F.xxhash64("doc_id")), "terms")
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in rows.select("h", "doc_id", (F.octet_length("x") / 4).cast("long").alias("n")).collect())
    held = np.cumsum([n for _, _, n in sizes])
    if len(held) and held[-1] > max_entries:
        last = max(0, int(np.searchsorted(held, max_entries, "right")) - 1)
        h, doc_id, _ = sizes[last]
        rows = rows.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("doc_id") <= doc_id)))
    table = rows.select("doc_id", "y", "x").toArrow().sort_by("doc_id").combine_chunks()  # an id is there once
    if not table.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0), hash_bits, prefix_chars, **params)
    x = table.column("x").chunk(0)
    data, at = payload(x)
    owners = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(at) // 4)
    return fit(owners, data.view("<u4"), table.column("y").to_numpy().astype(float), hash_bits, prefix_chars, **params)


RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1, higher: more toxic) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow({"doc_id": batch.column(0), "score": machine.score(t.as_py() for t in batch.column(1))}, RESULT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")


def reject(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    names = docs.columns
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(names.index("text")))
            yield batch.filter(pa.array(machine.score(texts) < threshold))

    return docs.mapInArrow(work, schema)
