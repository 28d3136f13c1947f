"""Quality rules with line labelling by a linear-chain conditional random field.

Base statistics fail a text outright (too few words, or too many words in repeated
five-word windows). All others are judged by their lines: each line with a word gets
features, Viterbi decoding marks it as content or boilerplate, and the text is kept when
the characters of its content lines are min_share or more of all.

The field learns from labelled documents: lines of documents labelled good count as
content, those of documents labelled bad as boilerplate; the chain carries the verdict
over lines that show nothing by themselves. Documents are joined to chains of `splice` in the
order of their ids' hash, so that changes from content to boilerplate and back are learned
too. Learning takes at most max_rows labelled ids (lowest hash) and of each long document a
run of max_lines lines from a place by its id's hash. With no labelled row all lines are
content.

Words are runs of bytes other than blank and \\x09-\\x0D, as for ASCII rules in SQL. Null
and empty texts have no word and fail the base rules. Repeated rows give repeated results,
other columns are passed by, texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import arrow, payload, pieces, word_parts
from tarnwell.llm.quality import labelled

WINDOW = 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CHAR = ~_BLANK & ((np.arange(256) & 0xC0) != 0x80)  # first bytes of characters in words
#: Byte classes of a line's features: lower, upper, digit, symbol, pipe, exclamation mark, other.
_KIND = np.full(256, 6, np.uint8)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "|", "!"]):
    _KIND[[ord(c) for c in _chars]] = _k
FEATURES = ["bias", "upper", "digits", "symbols", "pipes", "exclamations", "ended", "words", "word_length", "repeated", "stutter", "few_distinct"]
MIX = np.uint64(0x9E3779B97F4A7C15)


class Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class Lines:
    """A batch of texts cut into lines with words."""

    doc: np.ndarray  # of each line
    features: np.ndarray
    chars: np.ndarray


def examine(texts: pa.Array) -> tuple[dict[str, np.ndarray], Lines]:
    """The base statistics of each text, and all lines with words."""
    data, at = payload(texts)
    n, raw, ids = len(texts), data.tobytes(), Ids()
    n_words, n_dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    owner, first, size, words_in, repeated, distinct, numbers = [], [], [], [], [], [], []
    for i in range(n):
        start, seen = int(at[i]), set()
        for line in raw[start : at[i + 1]].split(b"\n"):
            own = [ids[w] for part in word_parts(line) for w in part]
            if own:
                owner.append(i)
                first.append(start)
                size.append(len(line))
                words_in.append(len(own))
                repeated.append(line in seen)
                distinct.append(len(set(own)))
                seen.add(line)
                numbers.append(np.array(own, np.int32))
            start += len(line) + 1
    doc, first, size, words_in = (np.array(x, np.int64) for x in (owner, first, size, words_in))
    repeated = np.array(repeated, bool)
    numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    np.add.at(n_words, doc, words_in)
    np.add.at(n_dup, doc, repeated)
    base = {
        "n_words": n_words,
        "word_chars": counted(_CHAR, data, at[:-1], at[1:]),
        "n_symbols": counted(_SYMBOL, data, at[:-1], at[1:]),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeat_words(numbers, n_words),
    }
    lines, count = np.arange(len(doc)), np.maximum(words_in, 1)
    kinds = np.stack([counted(_KIND == k, data, first, first + size) for k in range(7)], 1) / np.maximum(size, 1)[:, None]
    line_chars = counted(_CHAR, data, first, first + size)
    last = data[first + size - 1] if len(first) else np.zeros(0, np.uint8)
    word_line = np.repeat(lines, words_in)
    same = np.zeros(len(doc))
    if len(numbers) > 1:
        near = (numbers[1:] == numbers[:-1]) & (word_line[1:] == word_line[:-1])
        same = np.bincount(word_line[1:][near], minlength=len(doc)).astype(float)
    x = np.stack([
        np.ones(len(doc)), kinds[:, 1] > 0.3, kinds[:, 2] > 0.2, kinds[:, 3] > 0.05, kinds[:, 4] > 0.02, kinds[:, 5] > 0.05,
        np.isin(last, [ord(c) for c in ".!?"]), words_in < 3, line_chars / count > 12, repeated, same / count > 0.3, np.array(distinct, float) / count < 0.5,
    ], 1).astype(float)
    return base, Lines(doc, x, line_chars)


def counted(kind: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Bytes of a kind (a table of 256 flags) from each start up to its stop. Starts and stops ascend; a byte more for each byte of data is held."""
    if not len(starts):
        return np.zeros(0, np.int64)
    marks = np.append(kind[data], False).view(np.uint8)
    found = np.add.reduceat(marks, np.stack([starts, stops], 1).ravel(), dtype=np.int64)[::2]
    return np.where(stops > starts, found, 0)


def repeat_words(numbers: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Words in five-word windows that the same text holds twice or more."""
    total, docs = len(numbers), len(n_words)
    out = np.zeros(docs, np.int64)
    if total < WINDOW:
        return out
    doc = np.repeat(np.arange(docs), n_words)
    inside = doc[: total - WINDOW + 1] == doc[WINDOW - 1 :]
    with np.errstate(over="ignore"):
        key = doc[: total - WINDOW + 1].astype(np.uint64) * MIX
        for k in range(WINDOW):
            key = (key ^ (key >> np.uint64(29))) * MIX + numbers[k : total - WINDOW + 1 + k].astype(np.uint64)
    key = (key ^ (key >> np.uint64(32)))[inside]
    places = np.flatnonzero(inside)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, places[twice], 1)
    np.add.at(cover, places[twice] + WINDOW, -1)
    np.add.at(out, doc[np.cumsum(cover[:-1]) > 0], 1)
    return out


@dataclass
class Field:
    """Weights of a two-state chain: state 0 is content, state 1 boilerplate."""

    unary: np.ndarray  # features of a line -> score of state 1 over state 0
    step: np.ndarray  # [before, after]
    start: np.ndarray

    def viterbi(self, lines: Lines) -> np.ndarray:
        """The best state of each line, documents side by side."""
        n = len(lines.doc)
        if not n:
            return np.zeros(0, np.int64)
        score = np.stack([np.zeros(n), lines.features @ self.unary], 1)
        heads, long = heads_of(lines.doc)
        order = np.argsort(-long, kind="stable")
        heads, long = heads[order], long[order]
        came = np.zeros((n, 2), np.int8)
        best = self.start + score[heads]
        for t in range(1, long[0]):
            live = int(np.searchsorted(-long, -t, "left"))
            at = heads[:live] + t
            ways = best[:live, :, None] + self.step
            came[at] = ways.argmax(1)
            best[:live] = ways.max(1) + score[at]
        state = np.zeros(n, np.int64)
        state[heads + long - 1] = best.argmax(1)
        for t in range(long[0] - 1, 0, -1):
            live = int(np.searchsorted(-long, -t, "left"))
            at = heads[:live] + t
            state[at - 1] = came[at, state[at]]
        return state


def heads_of(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each document that has lines."""
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return heads, np.diff(np.concatenate([heads, [len(doc)]]))


def fit(features: np.ndarray, doc: np.ndarray, state: np.ndarray, rounds: int = 150, rate: float = 0.2, ridge: float = 1.0) -> Field:
    """Maximises the chains' conditional likelihood by Adam on forward-backward expectations."""
    field = Field(np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2))
    n = len(doc)
    if not n:
        return field
    heads, long = heads_of(doc)
    order = np.argsort(-long, kind="stable")
    heads, long = heads[order], long[order]
    lives = [int(np.searchsorted(-long, -t, "left")) for t in range(long[0])]
    is_head = np.zeros(n, bool)
    is_head[heads] = True
    follow = np.flatnonzero(~is_head)
    true_step = np.zeros((2, 2))
    np.add.at(true_step, (state[follow - 1], state[follow]), 1)
    true_start = np.bincount(state[heads], minlength=2)
    params = np.concatenate([field.unary, field.step.ravel(), field.start])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, rounds + 1):
        unary, step, start = params[: len(FEATURES)], params[len(FEATURES) : -2].reshape(2, 2), params[-2:]
        score = np.stack([np.zeros(n), features @ unary], 1)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[heads] = start + score[heads]
        for t in range(1, long[0]):
            at = heads[: lives[t]] + t
            ahead[at] = np.logaddexp(*(ahead[at - 1][:, :, None] + step).transpose(1, 0, 2)) + score[at]
        for t in range(long[0] - 1, 0, -1):
            at = heads[: lives[t]] + t
            back[at - 1] = np.logaddexp(*(step[None] + (score[at] + back[at])[:, None, :]).transpose(2, 0, 1))
        both = ahead + back
        total = np.logaddexp(both[:, 0], both[:, 1])
        p = np.exp(both - total[:, None])
        pair = np.exp(ahead[follow - 1][:, :, None] + step + (score[follow] + back[follow])[:, None, :] - total[follow][:, None, None])
        grad = np.concatenate([features.T @ ((state == 1) - p[:, 1]), (true_step - pair.sum(0)).ravel(), true_start - p[heads].sum(0)]) - ridge * params
        grad /= n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return Field(params[: len(FEATURES)], params[len(FEATURES) : -2].reshape(2, 2), params[-2:])


def train(docs: DataFrame, labels: DataFrame, teaches: Column | None = None, max_rows: int = 4000, max_lines: int = 200, splice: int = 4, **params) -> Field:
    """A field from at most max_rows documents of labels.quality and max_lines lines of each, in chains of `splice` documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            _, lines = examine(batch.column(1))
            got = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = lines.features[slice(*np.searchsorted(lines.doc, [i, i + 1]))]
                begin = xxhash.xxh3_64_intdigest(str(doc_id)) % max(1, len(own) - max_lines + 1)
                got.append(own[begin : begin + max_lines].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], ["doc_id", "y", "x"])

    teaches = F.lit(True) if teaches is None else teaches
    rows = labelled(docs, labels, "quality", teaches, max_rows).select("doc_id", F.coalesce("text", F.lit("")), "y").mapInArrow(work, "doc_id long, y int, x binary").collect()
    rows = [r for r in sorted(rows, key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["doc_id"])) if r["x"]]
    lists = [np.frombuffer(r["x"], np.uint8).reshape(-1, len(FEATURES)) for r in rows]
    doc = np.repeat(np.arange(len(rows)) // splice, [len(x) for x in lists])
    state = np.repeat(np.array([1 - r["y"] for r in rows], np.int64), [len(x) for x in lists])
    return fit(np.concatenate(lists).astype(float) if lists else np.zeros((0, len(FEATURES))), doc, state, **params)


RESULT = pa.schema([("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])


def judge(docs: DataFrame, field: Field, min_share: float = 0.5, least_words: int = 10, most_repeat_percent: int = 20) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and content_share (characters of content lines over all) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            base, lines = examine(batch.column(1))
            content = np.bincount(lines.doc, lines.chars * (field.viterbi(lines) == 0), batch.num_rows)
            share = content / np.maximum(np.bincount(lines.doc, lines.chars, batch.num_rows), 1)
            failed = (base["n_words"] < least_words) | (100 * base["n_repeat_words"] > most_repeat_percent * base["n_words"])
            yield arrow({"doc_id": batch.column(0), **base, "base_failed": failed, "kept": ~failed & (share >= min_share), "content_share": share}, RESULT)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(work, schema)
