"""Language identification by compression.

For each language a raw-content Zstandard dictionary is made of text in it. A text is
compressed with each dictionary; the language whose dictionary gives the fewest bytes
wins, and the answer is marked as rejected where the runner-up is almost as small.

Every value of lang with a letter in its texts is learned. The rows of a language are
sampled by a hash of id and text (about sample_rows of them), and each gives a piece from a
hashed place in its text, so that the sample is spread over the corpus and over the texts.
All sampled rows get the same share of the dictionary, in hash order; what shorter ones leave
goes to the others. A dictionary has dict_bytes at most, and fewer (all_bytes by the number
of languages) where there are over 512 languages: fewer rows teach, no language is left out.
Only letters, lower-cased, take part, so that digits, marks and capitals don't speak for
a language. Whole texts are scored, in blocks of block_chars letters and blanks.

Texts that are null or have no letter get `und` with score 0. Ties go to the language
with more rows to learn from. With nothing learned, each text is `und`. Rows with null text or
language, or with a null id, don't teach; rows that repeat id and text teach once; other
columns are passed by. Scoring takes time in proportion to the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import arrow

UND = "und"
_letters = regex.compile(r"\p{L}+").findall


def letters_only(text: str | None) -> str:
    return " ".join(_letters(text.lower())) if text else ""


def piece_of(text: str, place: int, piece_chars: int, want: int) -> bytes:
    """want bytes of letters at most, from a hashed place in the text; from anywhere if there is no letter."""
    start = place % max(1, len(text) - piece_chars + 1)
    plain = (letters_only(text[start : start + piece_chars]) or letters_only(text)).encode()
    start = place % max(1, len(plain) - want + 1)
    return plain[start : start + want]


def evenly(pieces: list[bytes], room: int) -> bytes:
    """All pieces cut to the same length, the greatest that fits in room with blanks between them."""
    room -= max(0, len(pieces) - 1)
    share = 0
    for i, n in enumerate(sorted(map(len, pieces))):
        share = room // (len(pieces) - i)
        if n > share:
            break
        room, share = room - n, n
    return b" ".join(p[:share] for p in pieces)


SAMPLE = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("piece", pa.binary())])
CONTENT = pa.schema([("lang", pa.string()), ("content", pa.binary())])


def train(docs: DataFrame, teaches: Column, sample_rows: int = 400, piece_chars: int = 4096, dict_bytes: int = 1 << 15, all_bytes: int = 16 << 20) -> dict[str, bytes]:
    """A raw-content dictionary for each language, the most frequent one first.

    Two scans: one counts rows by language, one takes each row with the chance that gives
    sample_rows by language. Pieces are cut and joined on the executors.
    """
    row_hash = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(17))
    learned = docs.where(teaches & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    learned = learned.select(F.col("lang").cast("string"), F.col("text").cast("string"), row_hash.alias("h"))
    counts = learned.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return {}
    room = max(64, min(dict_bytes, all_bytes // len(counts)))
    # a share is about 64 bytes at least; and with 32 rows or more expected, no language goes without any
    most = max(32, min(sample_rows, room // 64))
    # the bytes wanted of a row are twice its share, for rows that are short
    plan = [(r["lang"], min(1.0, most / max(1, r["different"])), max(64, 2 * room // max(1, min(most, r["different"])))) for r in counts]
    chances = docs.sparkSession.createDataFrame(plan, "lang string, chance double, want long")
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, text, h, want = (c.to_pylist() for c in batch.columns)
            # the low bits of the hash have chosen the row
            yield arrow({"lang": lang, "h": h, "piece": [piece_of(t, (x >> 30) & 0x3FFFFFFF, piece_chars, w) for t, x, w in zip(text, h, want)]}, SAMPLE)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = ([r["piece"] for r in rows.as_py()] for rows in batch.column(1))
            yield arrow({"lang": batch.column(0), "content": [evenly([p for p in x if p][: max(room // 64, 1)], room) for x in pieces]}, CONTENT)

    sample = learned.join(F.broadcast(chances), "lang").where(unit < F.col("chance")).select("lang", "text", "h", "want").mapInArrow(cut, "lang string, h long, piece binary")
    grouped = sample.groupBy("lang").agg(F.sort_array(F.collect_set(F.struct("h", "piece"))).alias("rows"))
    found = {r["lang"]: bytes(r["content"]) for r in grouped.mapInArrow(join, "lang string, content binary").collect()}
    return {r["lang"]: found[r["lang"]] for r in counts if found.get(r["lang"])}


class Compressor:
    """The compressors of all languages."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block_chars: int):
        self.languages, self.block = list(dictionaries), block_chars
        made = [zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k in self.languages]
        for d in made:
            d.precompute_compress(level=level)
        self.compress = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in made]

    def judge(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        plain = letters_only(text).encode()
        if not plain or not self.languages:
            return UND, 0.0, True
        sizes = np.zeros(len(self.languages))
        for start in range(0, len(plain), self.block):
            block = plain[start : start + self.block]
            sizes += [len(c(block)) for c in self.compress]
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = 1.0 if len(order) == 1 else float((sizes[order[1]] - best) / sizes[order[1]])
        weights = np.exp(-(sizes - best) / max(1.0, 0.02 * best))
        return self.languages[order[0]], float(1.0 / weights.sum()), margin < min_margin


RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01, level: int = 6, block_chars: int = 1 << 14) -> DataFrame:
    """doc_id, lang_pred, score and rejected (the margin over the runner-up is below min_margin) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Compressor(dictionaries, level, block_chars).judge
        for batch in batches:
            rows = [(i, *judge(text, min_margin)) for i, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)))]
            if rows:
                yield arrow(dict(zip(RESULT.names, zip(*rows))), RESULT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")
