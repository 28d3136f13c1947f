"""BPE encoding and decoding.

Encoding is exact and linear in a word's length. An Aho-Corasick automaton over the
vocabulary finds the longest token that starts at each place. The encoder walks from left
to right, takes the longest token whose neighbourhood to the token before it is one that
merging could have left standing (the pair-compatibility table), and steps back where no
token fits. Decoding gathers bytes through an offset table: one blob with all token
strings and the place of each in it.

Null texts count as empty; empty texts give no tokens. Very long texts are worked on
whole. Repeated rows give repeated results; other input columns are passed by.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import arrow, ragged

#: Words whose ids a worker remembers; the memory of it is dropped when full.
MEMO_WORDS = 250_000
#: White space as Unicode's White_Space lists it, and the word pattern of the tokenizer file.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, as symbol -> byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """A word-end BPE vocabulary file, encoding as its tokenizers description says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.words = regex.compile(pattern).findall
        self.spaces = regex.compile(f"[{SPACE}]+").sub
        self.split_special = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")").split
        self._tables(model)
        self._offsets({**model["vocab"], **self.special})
        self.memo: dict[str, bytes] = {}

    def _tables(self, model: dict) -> None:
        symbols, end = byte_symbols(), self.end

        def inner(token: str) -> str:
            """One character a byte; the last of a word-end token is raised by 256."""
            closed = token.endswith(end) and token != end
            text = "".join(chr(symbols[c]) for c in (token[: -len(end)] if closed else token))
            return text[:-1] + chr(ord(text[-1]) + 256) if closed else text

        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        text_of = {i: inner(t) for t, i in vocab.items()}
        # rank order of ids: single symbols first, then the merges in turn
        self.rank: dict[int, int] = {}
        self.id_of: list[int] = []
        made: dict[str, int] = {}
        singles = [i for i, t in text_of.items() if len(t) == 1]
        for i in sorted(singles):
            made[text_of[i]] = len(self.id_of)
            self.id_of.append(i)
        self.halves = [(r, r) for r in range(len(self.id_of))]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right = made[inner(a)], made[inner(b)]
            whole = inner(a) + inner(b)
            if whole not in made:
                made[whole] = len(self.id_of)
                self.id_of.append(vocab[a + b])
                self.halves.append((left, right))
            self.joined.setdefault((left, right), made[whole])
        self.texts = [""] * len(self.id_of)
        for text, r in made.items():
            self.texts[r] = text
        self.shorter = [next((made[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), -1) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for text, r in made.items():
            self.automaton.add_word(text, r)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.texts]
        self.pairs: dict[tuple[int, int], bool] = {}

    def _offsets(self, vocab: dict[str, int]) -> None:
        """The offset table: token strings, each with a blank after it, by id."""
        strings = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            strings[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.places = np.concatenate([[0], np.cumsum([len(s) for s in strings])])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined texts of two tokens ends in just these two."""
        key = (left, right)
        if (known := self.pairs.get(key)) is not None:
            return known
        limit, out = 1 << 60, True
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and whole < limit:
                out = False
                break
            # undo the later of the two merges that border on each other
            if left > right:
                limit, part = left, self.halves[left][1]
                if part != left:
                    left = part
                    continue
                limit, part = right + 1, self.halves[right][0]
                if part == right:
                    break
                right = part
            else:
                limit, part = right + 1, self.halves[right][0]
                if part != right:
                    right = part
                    continue
                limit, part = left, self.halves[left][1]
                if part == left:
                    break
                left = part
        if len(self.pairs) > 4 * MEMO_WORDS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pattern, without a memo."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        text = raw[:-1] + chr(ord(raw[-1]) + 256)
        size, lengths = len(text), self.lengths
        longest = [-1] * size
        for stop, r in self.automaton.iter(text):
            start = stop + 1 - lengths[r]
            if longest[start] < 0 or lengths[r] > lengths[longest[start]]:
                longest[start] = r
        open_ends = bytearray(b"\1") * (size + 1)
        stack: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while True:
                end = at + lengths[token]
                if open_ends[end] and (not stack or self.compatible(stack[-1], token)):
                    stack.append(token)
                    at = end
                    token = longest[at] if at < size else -1
                    break
                token = self.shorter[token]
                if token < 0:  # nothing fits from here on: step back
                    open_ends[at] = 0
                    token = stack.pop()
                    at -= lengths[token]
                    break
        return [self.id_of[r] for r in stack]

    def _plain(self, text: str) -> bytes:
        text = self.spaces(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        words, memo = self.words(text), self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            got = memo.get(w)
            if got is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                got = np.array(self.encode_word(w), "<u4").tobytes()
                if len(w) <= 64:
                    memo[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        parts = self.split_special(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens, joined with blanks as a file without a decoder has it."""
        if not len(ids):
            return b""
        starts = self.places[ids]
        return self.blob[ragged(starts, self.places[ids.astype(np.int64) + 1] - starts)][:-1].tobytes()


RESULT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[object, bytes, bytes]]:
    bpe = tokenizer(path)
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids = bpe.encode(text.as_py() or "")
            yield doc_id.as_py(), ids, bpe.decode(np.frombuffer(ids, "<u4"))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (UTF-8) of each row's text.

    path: a word-end BPE vocabulary file that every executor can open.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, decoded in _coded(batches, path):
            yield arrow({"doc_id": [doc_id], "ids": [ids], "decoded": [decoded]}, RESULT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_decode, with counts and digests in place of the ids and texts themselves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) for i, ids, text in _coded(iter([batch]), path)]
            if rows:
                yield arrow(dict(zip(DIGEST.names, zip(*rows))), DIGEST)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
