"""Model calls as Arrow batches: a protocol, deterministic stand-ins, a registry and retries."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tarnwell.functions import text as tx
from tarnwell.functions.batches import in_steps, steps


class Model(Protocol):
    def generate(self, ruling: str, prompt: str) -> str: ...


@dataclass
class Echo:
    """Stand-in without a network: the first sentences of the ruling, marked by a hash of the prompt."""

    name: str = "echo"
    max_chars: int = 600

    def generate(self, ruling: str, prompt: str) -> str:
        return f"[{hashlib.sha256(prompt.encode()).hexdigest()[:8]}] {ruling[: self.max_chars]}"


@dataclass
class ModelConfig:
    name: str
    kind: str = "local"
    options: dict = field(default_factory=dict)
    tries: int = 3
    pause: float = 1.0  # seconds before the second try; each later wait is 1.5 times as long
    parallel: int = 1  # calls at a time within a task


#: Makes a model of its configuration, by kind. Kinds added on the driver go to the executors with each call.
REGISTRY: dict[str, Callable[[ModelConfig], Model]] = {"local": lambda c: Echo(c.name, **c.options)}
_OWN = ("tries", "pause", "parallel")


def configs(found: list[dict], only: str | None = None) -> list[ModelConfig]:
    """Model records as configurations, all or the one of a name."""
    out = [ModelConfig(r["name"], r.get("type", "local"), {k: v for k, v in r.items() if k not in ("name", "type", *_OWN)}, **{k: r[k] for k in _OWN if k in r}) for r in found]
    return out if only is None else [c for c in out if c.name == only]


def maker(config: ModelConfig) -> Callable[[ModelConfig], Model]:
    """What makes the models of a configuration's kind."""
    if config.kind not in REGISTRY:
        raise ValueError(f"Unknown model type: {config.kind}")
    return REGISTRY[config.kind]


def build(config: ModelConfig) -> Model:
    return maker(config)(config)


def retried(call: Callable[[], str], tries: int = 3, base: float = 1.5, sleep: Callable[[float], None] = time.sleep, pause: float = 1.0) -> str:
    """The call's result; after a failure it waits pause * base^k seconds and tries again."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(pause * base**k)
    raise ValueError("tries must be positive")


def answered(rows: DataFrame, config: ModelConfig, ruling: Column, prompt: Column, out: str = "generated", error: str = "error", where: Column | None = None) -> DataFrame:
    """rows with the model's answer to each and the error of a call that failed; all columns go along, so no row is lost or doubled.

    A model is built once a task, by the maker that its kind has on the driver. Failed calls
    wait and are tried again. where: rows that it doesn't hold for get nulls without a call.
    A row is called each time that the plan runs: write the result before using it twice, or
    keep answers in a ledger.
    """
    if taken := {out, error} & set(rows.columns):
        raise ValueError(f"columns are there already: {sorted(taken)}")
    make, kept = maker(config), len(rows.columns)
    asked = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make(config)

        def one(request: tuple[str | None, str | None, bool]) -> tuple[str | None, str | None]:
            r, p, wanted = request
            if not wanted:
                return None, None
            try:
                return retried(lambda: model.generate(r or "", p or ""), config.tries, pause=config.pause), None
            except Exception as failure:
                return None, str(failure)

        with ThreadPoolExecutor(max(1, config.parallel)) as pool:
            # small batches go out as they are made: a task holds the one it was given and one step's texts
            for batch in (whole.slice(a, n) for whole in batches for a, n in steps(whole.columns)):
                requests = zip(*[batch.column(kept + i).to_pylist() for i in range(3)])
                made = list(pool.map(one, requests) if config.parallel > 1 else map(one, requests))
                columns = [pa.array([m[i] for m in made], pa.string()) for i in (0, 1)]
                schema = pa.schema([*[batch.schema.field(i) for i in range(kept)], (out, pa.string()), (error, pa.string())])
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *columns], schema=schema)

    schema = StructType([*rows.schema.fields, StructField(out, StringType()), StructField(error, StringType())])
    return rows.select("*", ruling.cast("string").alias("_ruling"), prompt.cast("string").alias("_prompt"), asked.alias("_asked")).mapInArrow(work, schema)


class Ask(Protocol):
    """`answered`, or a ledger's `ask`."""

    def __call__(self, rows: DataFrame, config: ModelConfig, ruling: Column, prompt: Column, out: str = "generated", error: str = "error", where: Column | None = None) -> DataFrame: ...


def generate(rows: DataFrame, config: ModelConfig, key: str, ruling: str, prompt: str, ask: Ask = answered) -> DataFrame:
    """key, model, generated, error of each row; a failed call fills error."""
    made = ask(rows.select(F.col(key), F.col(ruling).alias("_r"), F.col(prompt).alias("_p")), config, F.col("_r"), F.col("_p"))
    return made.select(key, F.lit(config.name).alias("model"), "generated", "error")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key, null like any other, isn't in done."""
    have = done.select(F.col(key).alias("_done")).distinct()
    return rows.join(have, F.col(key).eqNullSafe(F.col("_done")), "left_anti")


def run_generation(rows: DataFrame, models: list[ModelConfig], key: str, ruling: str, prompt: str, reference: str, done: DataFrame | None = None, ask: Ask = answered) -> DataFrame:
    """key, model, generated_press, reference_press, error and prompt of each row for each model.

    done: results of an earlier run; what it holds is kept and not made again, so rows are told
    apart by key there. Without it null and repeated keys are rows like any others. The answer
    is cut to what follows the request; a failed call keeps its row, with empty text and the error.
    """
    columns = [key, "model", "generated_press", "reference_press", "error", "prompt"]
    parts = []
    for config in models:
        todo = rows if done is None else not_done(rows, done.where(F.col("model") == config.name), key)
        todo = todo.select(F.col(key), F.col(ruling).alias("_r"), F.col(prompt).alias("prompt"), F.col(reference).alias("reference_press"))
        made = ask(todo, config, F.col("_r"), F.col("prompt"))
        given = F.concat(F.lit(f"{tx.RULING_MARK} "), "_r", F.lit("\n\n"), "prompt")
        text = F.coalesce(tx.generated_part(F.col("generated"), F.coalesce(given, F.lit(""))), F.lit(""))
        parts.append(made.select(F.col(key), F.lit(config.name).alias("model"), text.alias("generated_press"), "reference_press", F.coalesce("error", F.lit("")).alias("error"), "prompt"))
    new = reduce(DataFrame.unionByName, parts)
    return new.select(*columns) if done is None else done.select(*columns).unionByName(new.select(*columns))


@dataclass
class Token:
    """What a language model says of a word."""

    text: str
    lemma: str
    pos: str = "NOUN"
    stop: bool = False


#: Parts of speech that are kept, and the length from which long texts are cut, and to which.
CONTENT_POS = ["NOUN", "VERB", "ADJ", "ADV"]
LONG_CHARS, CUT_CHARS = 5000, 1000


def lemmas(text: Column, analyse: Callable[[str], list[Token]], cut_long: bool = False) -> Column:
    """Lower-cased lemmas of content words: letters only, three or more, no stop words; joined by blanks. Null gives an empty text.

    analyse: a tagger's call, made in Arrow batches. cut_long: texts over LONG_CHARS count with their first CUT_CHARS.
    """

    def some(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            t = t or ""
            found = analyse(t[:CUT_CHARS] if cut_long and len(t) > LONG_CHARS else t) if t else []
            out.append(" ".join([x.lemma.lower() for x in found if not x.stop and x.pos in CONTENT_POS and len(x.text) > 2 and x.text.isalpha()]))
        return pa.array(out, pa.string())

    @F.arrow_udf(StringType())
    def call(texts: pa.Array) -> pa.Array:
        return in_steps(some, texts)

    return call(text)


def token_length(text: Column, count: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text by a tokenizer's count, or by the estimate; null has none."""
    if count is None:
        return F.coalesce(tx.tokens_estimate(text), F.lit(0).cast("long"))

    @F.arrow_udf(LongType())
    def call(texts: pa.Array) -> pa.Array:
        return pa.array([count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return call(text)


def sign_vectors(words: pa.Array) -> pa.Array:
    """Stand-in for a transformer's token vectors: 16 signs of a digest for each word."""
    flat = words.flatten().dictionary_encode()
    digests = [np.frombuffer(hashlib.sha256(w.encode()).digest()[:2], np.uint8) for w in flat.dictionary.to_pylist()]
    table = np.unpackbits(np.array(digests, np.uint8).reshape(-1, 2), axis=1).astype(float) * 2 - 1
    vectors = table[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros((0, 16))
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * 16), pa.array(vectors.ravel()))
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), inner)


@F.arrow_udf(ArrayType(ArrayType(DoubleType())))
def hashed_vectors(words: pa.Array) -> pa.Array:
    """The stand-in's vectors as a column."""
    return sign_vectors(words)


def normalised(text: Column, stop_words: list[str] = tx.STOP_WORDS) -> Column:
    """Stand-in for lemmas: lower-cased words of three letters or more without stop words, joined by blanks; null gives an empty text."""
    kept = F.filter(tx.words(F.coalesce(text, F.lit(""))), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$") & ~w.isin(stop_words))
    return F.array_join(kept, " ")
