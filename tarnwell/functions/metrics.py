"""Overlap and n-gram metrics of text pairs, vector similarity and significance."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tarnwell.functions import text as tx
from tarnwell.functions.batches import in_steps
from tarnwell.functions.stemming import porter

#: Weights of BLEU-1 to BLEU-4, the smoothing of empty n-gram matches, errors of the factual metrics.
BLEU_WEIGHTS = {1: (1.0, 0.0, 0.0, 0.0), 2: (0.5, 0.5, 0.0, 0.0), 3: (0.33, 0.33, 0.33, 0.0), 4: (0.25, 0.25, 0.25, 0.25)}
BLEU_EPSILON = 0.1
NO_QUESTIONS, NO_ANSWERS, NO_SCORES = "Keine gültigen Fragen generiert", "Keine gültigen Antwortpaare gefunden", "Keine gültigen Scores berechnet"
NO_CLAIMS = "Keine gültigen Behauptungen extrahiert"


def coded(*sides: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each list array the row of each word and a number for it; equal words have equal numbers on all sides."""
    words = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode()
    number, out, at = words.indices.to_numpy(zero_copy_only=False), [], 0
    for s in sides:
        sizes = s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out.append((np.repeat(np.arange(len(s)), sizes), number[at : at + int(sizes.sum())].astype(np.int64)))
        at += int(sizes.sum())
    return out


def counted(rows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, count and first place of the different items of each row."""
    width = int(items.max(initial=0)) + 1
    key, first, n = np.unique(rows * width + items, return_index=True, return_counts=True)
    return key // width, key % width, n, first


def _shared_keywords(reference: pa.Array, generated: pa.Array, most: pa.Array) -> pa.Array:
    rows, k = len(reference), most[0].as_py() if len(most) else 0
    # the stop words have numbers too, as a last row
    *sides, (_, stop) = coded(reference, generated, pa.array([tx.STOP_WORDS], reference.type))
    best = []
    for r, w in sides:
        kept = ~np.isin(w, stop)
        r, w = r[kept], w[kept]
        row, word, n, first = counted(r, w)
        order = np.lexsort((first, -n, row))
        row, word = row[order], word[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best.append((row[place < k], word[place < k]))
    width = max([int(w.max(initial=0)) for _, w in best]) + 1
    (ra, wa), (rb, wb) = best
    both = np.bincount(ra[np.isin(ra * width + wa, rb * width + wb)], minlength=rows)
    a, b = np.bincount(ra, minlength=rows), np.bincount(rb, minlength=rows)
    return pa.array(np.where((a > 0) & (b > 0), both / np.maximum(a + b - both, 1), 0.0))


@F.arrow_udf(DoubleType())
def _keyword_overlap(reference: pa.Array, generated: pa.Array, most: pa.Array) -> pa.Array:
    return in_steps(_shared_keywords, reference, generated, most)


def keyword_overlap(reference: Column, generated: Column, most: int = 20) -> Column:
    """Jaccard of the most frequent words of both texts, stop words aside; ties in frequency go to the word that comes first.

    Words are split in the engine and counted in Arrow batches: nothing is shuffled.
    """
    return keywords_shared(*[tx.words(F.coalesce(c, F.lit(""))) for c in (reference, generated)], most)


def keywords_shared(reference: Column, generated: Column, most: int = 20) -> Column:
    """As keyword_overlap, of two word lists."""
    return _keyword_overlap(reference, generated, F.lit(most))


def gram_matches(reference: Column, generated: Column, orders: tuple[int, ...]) -> Column:
    """An array of structs (k, matched, n_ref, n_gen) of the n-grams of each order of two word lists; matches are clipped.

    Longer n-grams are numbered from pairs of a shorter one and a word, for all rows of a step of the batch at once.
    """

    def counts(a: pa.Array, b: pa.Array) -> pa.Array:
        rows, sides = len(a), coded(a, b)
        grams, found = [w for _, w in sides], {}
        for k in range(1, max(orders) + 1):
            if k > 1:
                width = max(int(w.max(initial=0)) for _, w in sides) + 1
                joined, keep = [], []
                for (r, w), g in zip(sides, grams):
                    last = len(w) - k + 1
                    keep.append(np.flatnonzero(r[: max(last, 0)] == r[k - 1 :]) if last > 0 else np.zeros(0, np.int64))
                    joined.append(g[keep[-1]] * width + w[keep[-1] + k - 1])
                number = np.unique(np.concatenate(joined), return_inverse=True)[1].reshape(-1)
                cut = len(joined[0])
                for side, (at, part) in enumerate(zip(keep, (number[:cut], number[cut:]))):
                    grams[side] = np.zeros(len(sides[side][1]), np.int64)
                    grams[side][at] = part
                lists = [(sides[i][0][keep[i]], grams[i][keep[i]]) for i in (0, 1)]
            else:
                lists = [(sides[i][0], grams[i]) for i in (0, 1)]
            if k in orders:
                width = max(int(g.max(initial=0)) for _, g in lists) + 1
                (ka, na), (kb, nb) = (np.unique(r * width + g, return_counts=True) for r, g in lists)
                same, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                matched = np.bincount(same // width, np.minimum(na[ia], nb[ib]), rows).astype(np.int64)
                found[k] = (matched, *(np.bincount(r, minlength=rows) for r, _ in lists))
        columns = [np.stack([found[k][i] for k in orders], 1).ravel() for i in range(3)]
        items = pa.StructArray.from_arrays([pa.array(np.tile(np.array(orders, np.int32), rows)), *map(pa.array, columns)], ["k", "matched", "n_ref", "n_gen"])
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(orders)), items)

    @F.arrow_udf("array<struct<k:int,matched:bigint,n_ref:bigint,n_gen:bigint>>")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_steps(counts, a, b)

    return count(_list(reference), _list(generated))


def _list(words: Column) -> Column:
    return F.coalesce(words, F.array().cast("array<string>"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)


def f_measure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)


def _stems(words: pa.Array) -> pa.Array:
    flat = words.flatten().dictionary_encode()
    made = pa.array([porter(w) if len(w) > 3 else w for w in flat.dictionary.to_pylist()], pa.string())
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), made.take(flat.indices))


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """The words with those of more than three letters cut to their stem."""
    return in_steps(_stems, words)


def rouge_words(text: Column, stem: bool = True) -> Column:
    """Word tokens for ROUGE: with stems runs of a-z and digits, cut to their stem; without, lower-cased words."""
    if not stem:
        return tx.words(text)
    return stems(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != ""))


def rouge_n(reference: Column, generated: Column, orders: tuple[int, ...] = (1, 2)) -> Column:
    """An array of structs (k, precision, recall, fmeasure, n_ref, n_gen) of ROUGE-k of two word lists."""

    def one(x: Column) -> Column:
        p, r = _ratio(x["matched"], x["n_gen"]), _ratio(x["matched"], x["n_ref"])
        return F.struct(x["k"].alias("k"), p.alias("precision"), r.alias("recall"), f_measure(p, r).alias("fmeasure"), x["n_ref"].alias("n_ref"), x["n_gen"].alias("n_gen"))

    return F.transform(gram_matches(reference, generated, orders), one)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of a longest common subsequence, by bits: a mask of its places in a for each word, and one addition, whose carries run over all places at once, for each word of b."""
    words = a.tolist()
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    full = free = (1 << len(words)) - 1
    for w in b.tolist():
        if hit := free & masks.get(w, 0):
            free = (free + hit | free - hit) & full
    return len(words) - free.bit_count()


def _lcs_lengths(a: pa.Array, b: pa.Array) -> pa.Array:
    (ra, wa), (rb, wb) = coded(a, b)
    at, to = (np.searchsorted(r, np.arange(len(a) + 1)) for r in (ra, rb))
    return pa.array([lcs(wa[at[i] : at[i + 1]], wb[to[i] : to[i + 1]]) for i in range(len(a))], pa.int64())


@F.arrow_udf(LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    return in_steps(_lcs_lengths, a, b)


def rouge_l(reference: Column, generated: Column) -> Column:
    """A struct (precision, recall, fmeasure) of the longest common subsequence of two word lists."""
    a, b = _list(reference), _list(generated)
    common = lcs_length(a, b)
    p, r = _ratio(common, F.size(b)), _ratio(common, F.size(a))
    return F.struct(p.alias("precision"), r.alias("recall"), f_measure(p, r).alias("fmeasure"))


def bleu_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters, and single marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)[{tx.LOWER}\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))


def bleu(reference: Column, generated: Column, weights: dict[int, tuple[float, ...]] = BLEU_WEIGHTS) -> Column:
    """A struct of bleu<name> for each tuple of weights by n-gram order.

    Modified precisions, epsilon for empty matches, brevity penalty; 0 without a common word.
    """
    orders = tuple(range(1, max(map(len, weights.values())) + 1))
    found = gram_matches(bleu_tokens(reference), bleu_tokens(generated), orders)

    def scored(m: Column) -> Column:
        logs = [F.log(F.when(m[i]["matched"] == 0, BLEU_EPSILON).otherwise(m[i]["matched"]) / F.greatest(m[i]["n_gen"], F.lit(1))) for i in range(len(orders))]
        n_ref, n_gen = m[0]["n_ref"], m[0]["n_gen"]
        brevity = F.when(n_gen == 0, 0.0).when(n_gen > n_ref, 1.0).otherwise(F.exp(1 - n_ref / F.greatest(n_gen, F.lit(1))))
        out = []
        for name, own in weights.items():
            total = sum((w * x for w, x in zip(own[1:], logs[1:]) if w), own[0] * logs[0])
            out.append(F.when(m[0]["matched"] == 0, 0.0).otherwise(brevity * F.exp(total)).alias(f"bleu{name}"))
        return F.struct(*out)

    return F.transform(F.array(found), scored)[0]  # bound once: the counts are used many times


def meteor_score(reference: list[str], generated: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR of one pair with the exact and the stem stage. Words are matched from the last one backwards, each with the last equal one that is left."""
    left, pairs = list(enumerate(reference)), []
    open_ = list(enumerate(generated))
    for key in (lambda w: w, porter):
        places: dict[str, list[int]] = {}
        for i, w in left:
            places.setdefault(key(w), []).append(i)
        rest = []
        for j, w in reversed(open_):
            if places.get(key(w)):
                pairs.append((j, places[key(w)].pop()))
            else:
                rest.append((j, w))
        used = {i for _, i in pairs}
        left, open_ = [(i, w) for i, w in left if i not in used], rest[::-1]
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, r = len(pairs) / len(generated), len(pairs) / len(reference)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / len(pairs)) ** beta)


def _last_with_last(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b, both rows and items, that are matched: equal items of a row, the last with the last."""
    width, longest = max(int(k.max(initial=0)) for _, k in (a, b)) + 1, max(len(a[0]), len(b[0]), 1)
    keys, places = [], []
    for rows, items in (a, b):
        key = rows * width + items
        order = np.argsort(key, kind="stable")
        key = key[order]
        keys.append(key * longest + np.searchsorted(key, key, "right") - 1 - np.arange(len(key)))
        places.append(order)
    _, at, to = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    return places[0][at], places[1][to]


def _meteor(reference: pa.Array, generated: pa.Array, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> pa.Array:
    """meteor_score of all rows of a step at once, by the numbers of their words and of their words' stems."""
    flat = pa.concat_arrays([reference.flatten(), generated.flatten()]).dictionary_encode()
    number, sizes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in (reference, generated)]
    cut = int(sizes[0].sum())
    (ra, wa), (rb, wb) = ((np.repeat(np.arange(len(n)), n), w) for n, w in zip(sizes, (number[:cut], number[cut:])))
    at, to = _last_with_last((ra, wa), (rb, wb))
    left, open_ = np.delete(np.arange(len(wa)), at), np.delete(np.arange(len(wb)), to)
    if len(left) and len(open_):
        words = np.unique(np.concatenate([wa[left], wb[open_]]))
        stem = np.zeros(len(flat.dictionary), np.int64)
        stem[words] = pa.array([porter(w) for w in flat.dictionary.take(pa.array(words)).to_pylist()], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        more = _last_with_last((ra[left], stem[wa[left]]), (rb[open_], stem[wb[open_]]))
        at, to = np.concatenate([at, left[more[0]]]), np.concatenate([to, open_[more[1]]])
    order = np.argsort(to)
    at, to = at[order], to[order]
    row = rb[to]
    # a chunk begins at each pair that doesn't follow the one before on both sides
    begins = np.append(True, (np.diff(at) != 1) | (np.diff(to) != 1) | (np.diff(row) != 0))[: len(row)]
    pairs, chunks = np.bincount(row, minlength=len(reference)).tolist(), np.bincount(row[begins], minlength=len(reference)).tolist()
    out = [0.0] * len(reference)
    for i, (m, c, a, b) in enumerate(zip(pairs, chunks, sizes[0].tolist(), sizes[1].tolist())):
        if m:
            p, r = m / b, m / a
            out[i] = p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (c / m) ** beta)
    return pa.array(out, pa.float64())


@F.arrow_udf(DoubleType())
def meteor(reference: pa.Array, generated: pa.Array) -> pa.Array:
    return in_steps(_meteor, reference, generated)


def _folded(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value bound by a one-element array, so that it is worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    """The products of two arrays' elements, added up in order."""
    return _folded(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    length = F.sqrt(dot(vector, vector))
    return F.transform(F.arrays_zip(vector.alias("x"), F.array_repeat(length, F.size(vector)).alias("n")), lambda z: F.when(z["n"] > 0, z["x"].cast("double") / z["n"]).otherwise(0.0))


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of equally long vectors; an empty array gives an empty vector."""
    places = F.sequence(F.lit(0), F.greatest(F.size(vectors[0]), F.lit(1)) - 1)
    mean = F.transform(places, lambda i: _folded(F.transform(vectors, lambda v: v[i].cast("double"))) / F.size(vectors))
    return F.when(F.size(vectors) > 0, mean).otherwise(F.array().cast("array<double>"))


def semantic_similarity(reference: Column, generated: Column) -> Column:
    """Product of the mean-pooled token vectors of two texts at length 1."""
    return dot(unit(mean_pool(reference)), unit(mean_pool(generated)))


#: Cells of a table of cosines that are held at a time.
CELLS = 1 << 20


def _matrices(vectors: pa.ListArray) -> list[np.ndarray | None]:
    """A matrix of the vectors of each row; None for a null, for no vectors, and for vectors of different length or with nulls."""
    inner = vectors.values
    flat = inner.values
    starts, ends, null = vectors.offsets.to_numpy(), inner.offsets.to_numpy(), vectors.is_null().to_numpy(zero_copy_only=False)
    lacks = np.cumsum(np.append(0, flat.is_null().to_numpy(zero_copy_only=False))) if flat.null_count else None
    numbers, out = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), []
    for i in range(len(vectors)):
        a, b = starts[i], starts[i + 1]
        widths = np.diff(ends[a : b + 1])
        if null[i] or a == b or not widths[0] or (widths != widths[0]).any() or (lacks is not None and lacks[ends[b]] > lacks[ends[a]]):
            out.append(None)
            continue
        out.append(numbers[ends[a] : ends[b]].reshape(b - a, widths[0]))
    return out


def _at_length_1(matrix: np.ndarray) -> np.ndarray:
    """The rows of a matrix at length 1; zeros stay."""
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def best_cosines(reference: np.ndarray, generated: np.ndarray) -> tuple[float, float]:
    """Mean best cosine of the generated vectors (precision) and of the reference ones (recall), by products of blocks of CELLS."""
    step, recall, best = max(1, CELLS // len(generated)), 0.0, np.full(len(generated), -np.inf)
    for a in range(0, len(reference), step):
        table = reference[a : a + step] @ generated.T
        recall += float(table.max(1).sum())
        np.maximum(best, table.max(0), out=best)
    return float(best.mean()), recall / len(reference)


def _matched(a: np.ndarray | None, b: np.ndarray | None) -> tuple[float, float] | None:
    return None if a is None or b is None or a.shape[1] != b.shape[1] else best_cosines(_at_length_1(a), _at_length_1(b))


def _columns(found: list[tuple[float, ...] | None], names: list[str]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([f and f[k] for f in found], pa.float64()) for k in range(len(names))], names)


def _best(reference: pa.Array, generated: pa.Array) -> pa.Array:
    return _columns([_matched(a, b) for a, b in zip(_matrices(reference), _matrices(generated))], ["precision", "recall"])


@F.arrow_udf(StructType([StructField("precision", DoubleType()), StructField("recall", DoubleType())]))
def _greedy(reference: pa.Array, generated: pa.Array) -> pa.Array:
    return in_steps(_best, reference, generated)


def greedy_match(reference: Column, generated: Column) -> Column:
    """A struct (precision, recall, f1): mean best cosine of each token vector with those of the other side.

    Null parts where a side is null or has no vectors, where vectors have nulls, and where
    their lengths differ. A pair takes memory for its vectors and one block of cosines.
    """
    typed = [c.cast("array<array<double>>") for c in (reference, generated)]
    found = F.transform(F.array(_greedy(*typed)), lambda z: F.struct(z["precision"].alias("precision"), z["recall"].alias("recall"), f_measure(z["precision"], z["recall"]).alias("f1")))
    return found[0]


def vector_scores(reference: Column, generated: Column, vectors: Callable[[pa.Array], pa.Array]) -> Column:
    """A struct (precision, recall, f1, similarity) as of greedy_match and semantic_similarity, of two word lists and a model that makes their vectors within the task.

    vectors: Arrow lists of words to lists of vectors. Only words and scores pass between Spark and Python.
    """

    def one(a: np.ndarray | None, b: np.ndarray | None) -> tuple[float, ...] | None:
        best = _matched(a, b)
        return best and (*best, float(_at_length_1(a.mean(0, keepdims=True))[0] @ _at_length_1(b.mean(0, keepdims=True))[0]))

    def scores(a: pa.Array, b: pa.Array) -> pa.Array:
        return _columns([one(x, y) for x, y in zip(_matrices(vectors(a)), _matrices(vectors(b)))], ["precision", "recall", "similarity"])

    @F.arrow_udf("struct<precision:double,recall:double,similarity:double>")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_steps(scores, a, b)

    return once(score(_list(reference), _list(generated)), lambda z: F.struct(*[z[k].alias(k) for k in ("precision", "recall", "similarity")], F.when(z["precision"].isNotNull(), f_measure(z["precision"], z["recall"])).alias("f1")))


def word_share(source: Column, claim: Column) -> Column:
    """Stand-in for a classifier of claims: the share of a claim's different words that the source has."""
    own, other = F.array_distinct(tx.words(claim)), F.array_distinct(tx.words(source))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, other)) / F.greatest(F.size(own), F.lit(1)))


def claim_scores(source: Column, generated: Column, classify: Callable[[Column, Column], Column] = word_share, threshold: float = 0.5) -> Column:
    """A struct (score, consistency_ratio, claim_count, error) of the generated text's claims, each judged by classify(source, claim).

    Without a claim the score is NaN, the ratio null and the error says so.
    """
    found = tx.claims(F.coalesce(generated, F.lit("")))

    def scored(scores: Column) -> Column:
        n = F.size(scores)
        any_ = n > 0
        return F.struct(
            F.when(any_, _folded(scores) / F.greatest(n, F.lit(1))).otherwise(F.lit(float("nan"))).alias("score"),
            F.when(any_, F.size(F.filter(scores, lambda s: s >= threshold)) / F.greatest(n, F.lit(1))).alias("consistency_ratio"),
            n.alias("claim_count"),
            F.when(~any_, NO_CLAIMS).alias("error"),
        )

    return once(F.transform(found, lambda c: classify(source, c)), scored)


def answer_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the lower-cased words of two answers; null if either has none."""
    x, y = (F.array_distinct(tx.plain_words(F.lower(c))) for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def question_scores(questions: Column, source_answers: Column, generated_answers: Column, similar: Callable[[Column, Column], Column] = answer_jaccard) -> Column:
    """A struct (score, question_count, valid_answers, error) of answers to the same questions from two texts.

    Pairs count where both sides answered. Without a question, a pair or a score the score
    is NaN, valid_answers null, and the error says which.
    """
    pairs = F.filter(F.arrays_zip(source_answers.alias("a"), generated_answers.alias("b")), lambda z: (F.length(F.coalesce(z["a"], F.lit(""))) > 0) & (F.length(F.coalesce(z["b"], F.lit(""))) > 0))

    def scored(all_: Column) -> Column:
        scores = F.array_compact(all_)
        n, error = F.size(scores), F.when(F.size(questions) <= 0, NO_QUESTIONS).when(F.size(all_) == 0, NO_ANSWERS).when(F.size(scores) == 0, NO_SCORES)
        fine = error.isNull()
        return F.struct(
            F.when(fine, _folded(scores) / F.greatest(n, F.lit(1))).otherwise(F.lit(float("nan"))).alias("score"),
            F.greatest(F.size(questions), F.lit(0)).alias("question_count"),
            F.when(fine, n).alias("valid_answers"),
            error.alias("error"),
        )

    return once(F.transform(pairs, lambda z: similar(z["a"], z["b"])), scored)


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return _beta_tail(df / (df + t * t), df / 2, 0.5)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(x, k) if math.isfinite(x) and k > 0 else float("nan") for x, k in zip(t, df)], dtype="float64")


def welch(values: DataFrame, model: str, value: str, baseline: str | None = None) -> DataFrame:
    """model_a, model_b, t, df of all ordered pairs (or each model against the baseline); a model against itself has t 0."""
    stats = values.where(F.col(value).isNotNull()).groupBy(F.col(model).alias("m")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    side = lambda s: stats.select(*[F.col(c).alias(f"{c}_{s}") for c in ("m", "n", "mean", "var")])
    left, right = side("a"), side("b")
    if baseline is not None:
        right = right.where(F.col("m_b") == baseline)
    # one row by model on each side: the statistics, never the values, are paired
    both = left.crossJoin(F.broadcast(right))
    a, b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    same = F.col("m_a") == F.col("m_b")
    t = F.when(same, 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / F.sqrt(a + b))
    df = (a + b) ** 2 / (a**2 / (F.col("n_a") - 1) + b**2 / (F.col("n_b") - 1))
    return both.select(F.col("m_a").alias("model_a"), F.col("m_b").alias("model_b"), t.alias("t"), df.alias("df"))
