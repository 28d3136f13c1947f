"""Token-bounded chunks, merge levels and merge packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions import text as tx

PARAGRAPH = r"(?U)\n\s*\n+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH), tx.strip), lambda p: p != "")


def pieces(text: Column, size: int, break_at: str = PARAGRAPH) -> Column:
    """Paragraphs with their tokens and the separator before each; those over size as sentences."""
    parts = F.filter(F.transform(F.split(text, break_at), tx.strip), lambda p: p != "")

    def unit(piece: Column, sep: str) -> Column:
        return F.struct(piece.alias("text"), tx.tokens_estimate(piece).alias("tokens"), F.lit(sep).alias("sep"))

    return F.flatten(F.transform(parts, lambda p: F.when(tx.tokens_estimate(p) > size, F.transform(tx.sentences(p), lambda s: unit(s, " "))).otherwise(F.array(unit(p, "\n\n")))))


def pack(units: Column, size: int) -> Column:
    """Greedy chunks of (text, tokens, sep) units: the sum of tokens stays within size; a longer unit is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).cast("long").alias("held"))

    def step(acc: Column, u: Column) -> Column:
        full = (acc["open"] != "") & (acc["held"] + u["tokens"] > size)
        grown = F.when(acc["open"] == "", u["text"]).otherwise(F.concat(acc["open"], u["sep"], u["text"]))
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full, u["text"]).otherwise(grown).alias("open"),
            F.when(full, u["tokens"]).otherwise(acc["held"] + u["tokens"]).alias("held"),
        )

    return F.aggregate(units, start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def chunks(text: Column, size: int = 2048, break_at: str = PARAGRAPH) -> Column:
    """Chunks of a text: the text itself if it fits, else packed paragraphs and sentences."""
    return F.when(tx.tokens_estimate(text) <= size, F.array(text)).otherwise(pack(pieces(text, size, break_at), size))


def levels(n: int, max_context: int = 4096, max_summary: int = 900, chunk_size: int = 2048, ratio: float = 0.65) -> list[int]:
    """Summary lengths of the merge levels of n chunks, from the first to the last, which has max_summary."""
    fan_in, depth = max(2, (max_context - max_summary) // chunk_size), 0
    while n > 1:
        n, depth = -(-n // fan_in), depth + 1
    lengths = [max_summary] * min(depth, 1)
    while len(lengths) < depth:
        lengths.append(int(lengths[-1] * ratio))
    return lengths[::-1]


def level_lengths(n: Column, most: int = 1 << 12, **config) -> Column:
    """levels as a column, for up to most chunks; the table is a literal that grows with log n alone."""
    tops = sorted({k for k in range(1, most + 1) if k == 1 or levels(k, **config) != levels(k - 1, **config)}, reverse=True)
    out = F.array().cast("array<int>")
    for k in reversed(tops):
        lengths = levels(k, **config)
        out = F.when(n >= k, F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>")).otherwise(out)
    return out
