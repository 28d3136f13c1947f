"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics (shares of character classes, lengths, repetition of words and lines) come
from the text alone. Trees are grown level by level on binned statistics with logistic
loss; a full tree of depth d is an array of 2^d - 1 splits and 2^d leaves, so that scoring
a batch is d rounds of numpy gathers for all trees at once.

Learning takes at most max_rows labelled rows, those with the lowest hash of the id.
Null and empty texts have all-zero statistics and get a score like any text; with no
labelled row each score is 0.5. Rows with null id or null label don't teach; where an id
has several labels the mean decides (ties: 1). Repeated rows give repeated results, other
columns are passed by, texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import arrow, payload, pieces, word_parts

#: Byte classes of the character statistics; the last holds all bytes beyond ASCII.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "|", "#*$%&<>", "\"'();:?-/"]
#: Bytes of a text that one step works on.
STEP = 1 << 20
_CLASS = np.full(256, len(CLASSES), np.uint8)
_CLASS[128:] = len(CLASSES) + 1
for _k, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
N_CLASSES = len(CLASSES) + 2
NAMES = [f"class_{k}" for k in range(N_CLASSES)] + ["log_bytes", "log_words", "word_bytes", "distinct_words", "stutter", "line_words", "repeated_lines", "short_words", "ended_lines", "longest_word"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of len(NAMES) numbers for each text."""
    data, at = payload(texts)
    out = np.zeros((len(texts), len(NAMES)))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if a == b:
            continue
        for part in range(a, b, STEP):
            out[i, :N_CLASSES] += np.bincount(_CLASS[data[part : min(b, part + STEP)]], minlength=N_CLASSES)
        out[i, :N_CLASSES] /= b - a
        text = data[a:b].tobytes()
        w = held = stutter = short = longest = 0
        distinct, last = set(), None
        for words in word_parts(text, STEP):
            sizes = list(map(len, words))
            w, held, longest = w + len(words), held + sum(sizes), max(longest, max(sizes))
            short += sum(s < 3 for s in sizes)
            stutter += sum(map(bytes.__eq__, words, words[1:])) + (last == words[0])
            distinct.update(words)
            last = words[-1]
        if w:
            lines = [x for x in text.split(b"\n") if x.strip()]
            out[i, N_CLASSES:] = (
                np.log1p(len(text)), np.log1p(w), held / w, len(distinct) / w, stutter / w,
                w / len(lines), 1 - len(set(lines)) / len(lines), short / w, sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines), np.log1p(longest),
            )
    return out


@dataclass
class Trees:
    """Flattened trees: split statistic and threshold by tree and node, value by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(nodes + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - nodes].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Boosted trees on the logistic loss. A side of a split holds `least` in Hessian weight or the node isn't split."""
    nodes, features = 2**depth - 1, x.shape[1] if x.ndim == 2 else 0
    rate_of_1 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate_of_1 / (1 - rate_of_1)))
    empty = Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), base)
    if len(y) < 10 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    flat = binned + np.arange(features) * bins
    out_f, out_t, out_v = (np.zeros((trees, k)) for k in (nodes, nodes, nodes + 1))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (features * bins) + flat).ravel()
            shape = (width, features, bins)
            g = np.bincount(key, np.repeat(grad, features), width * features * bins).reshape(shape).cumsum(2)
            h = np.bincount(key, np.repeat(hess, features), width * features * bins).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // bins, best % bins
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            limit = np.array([cuts[k][j] if s and j < len(cuts[k]) else np.inf for k, j, s in zip(f, b, split)])
            out_f[t, first : first + width], out_t[t, first : first + width] = f, limit
            own = node - first
            node = 2 * node + 1 + (x[np.arange(len(y)), f[own]] > limit[own])
        leaf = node - nodes
        value = rate * np.bincount(leaf, grad, nodes + 1) / (np.bincount(leaf, hess, nodes + 1) + ridge)
        out_v[t] = value
        margin += value[leaf]
    return Trees(out_f.astype(np.int64), out_t, out_v, base)


def labelled(docs: DataFrame, labels: DataFrame, label: str, teaches: Column, max_rows: int) -> DataFrame:
    """doc_id, text and y of at most max_rows labelled ids, those of the lowest hash. The ids are few enough to broadcast: max_rows.

    An id that several rows have teaches once, with the smallest of their texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & teaches).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return own.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, teaches: Column, max_rows: int = 20_000, **params) -> Trees:
    """Trees from the labelled rows for which `teaches` (a condition on doc_id) holds."""
    width = len(NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(statistics(batch.column(1))), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = labelled(docs, labels, "quality", teaches, max_rows).select("doc_id", F.coalesce("text", F.lit("")), "y").mapInArrow(work, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.assign(order=[tuple(v) for v in rows["x"]]).sort_values(["doc_id", "order"])
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, width))
    return grow(x, rows["y"].to_numpy(float), **params)


RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            yield arrow({"doc_id": batch.column(0), "score": trees.score(statistics(batch.column(1)))}, RESULT)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(work, "doc_id long, score double")
