"""Hierarchical summaries: chunk prompts, attempts, merge packing, levels, final release, and the whole run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnwell.functions import chunking
from tarnwell.functions import text as tx
from tarnwell.operators.relations import coalesce_merge
from tarnwell.operators.selection import quantiles
from tarnwell.sources.config import Settings
from tarnwell.sources.scratch import scratch, settled
from tarnwell.sources.tables import delete, path_exists, write_csv

#: The built-in templates, with named places, and the tokens that are kept free beside them.
TEMPLATES = {
    "initial": "Summarize the following text in approximately {words} words:\n\n{text}",
    "merge": "Merge and summarize the following summaries in approximately {words} words:\n\n{text}",
    "context": "Given the context:\n{context}\n\nSummarize the following in approximately {words} words:\n\n{text}",
}
MERGE_RESERVE, RELEASE_RESERVE, RELEASE_TOKENS = 50, 10, 1024


class Summarizer(Protocol):
    def summarize(self, prompt: str, text: str, max_tokens: int) -> str: ...


class FirstSentences:
    """Stand-in without a network: a text's first sentences within the limit, or its first characters."""

    def summarize(self, prompt: str, text: str, max_tokens: int) -> str:
        out, room = "", 4 * max_tokens
        for sentence in _sentences(text):
            grown = f"{out} {sentence}" if out else sentence
            if len(grown) > room:
                break
            out = grown
        return out or text[:room]


def _sentences(text: str) -> list[str]:
    out, start = [], 0
    for i, sign in enumerate(text[:-1]):
        if sign in ".!?" and text[i + 1].isspace():
            out.append(text[start : i + 1].strip())
            start = i + 1
    return [s for s in [*out, text[start:].strip()] if s]


def filled(template: str, **values: Column) -> Column:
    """A template with columns at its named places; each place is filled once, so braces in texts do no harm."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        place, name = at
        parts += [F.lit(rest[:place]), values[name].cast("string")]
        rest = rest[place + len(name) + 2 :]
    return F.concat(*parts)


def words_for(tokens: Column, ratio: float) -> Column:
    return F.floor(tokens * F.lit(ratio)).cast("int")


def chunk_prompt(text: Column, words: Column, level: int, context: Column | None = None, templates: dict[str, str] = TEMPLATES) -> Column:
    """The request for a summary: chunks at level 0, merged summaries above, with context where there is some."""
    if level == 0:
        return filled(templates["initial"], words=words, text=text)
    merged = filled(templates["merge"], words=words, text=text)
    if context is None:
        return merged
    return F.when(F.coalesce(context, F.lit("")) != "", filled(templates["context"], context=context, words=words, text=text)).otherwise(merged)


def whole(summary: str, limit: int) -> bool:
    """Whether a summary is non-empty, within the token limit and ends like a sentence."""
    return bool(summary) and len(summary) // 4 <= limit and summary.rstrip().endswith((".", "!", "?", '"', "'"))


def tried(build: Callable[[], Summarizer], tries: int, check: bool = True) -> Callable[[Column, Column, Column], Column]:
    """A column function (prompt, text, max_tokens) to a struct (text, error): the first sound summary of up to `tries`, else the last one.

    A model is built once a batch. A call that fails is one of the tries; the text is null, with
    the last error, if all of them failed. Null prompts give nulls and call no model.
    """

    @F.arrow_udf("text string, error string")
    def call(prompt: pa.Array, text: pa.Array, limit: pa.Array) -> pa.Array:
        model, out = build(), []
        for p, t, n in zip(prompt.to_pylist(), text.to_pylist(), limit.to_pylist()):
            made = error = None
            for _ in range(tries if p is not None else 0):
                try:
                    made = model.summarize(p, t or "", n)
                except Exception as failure:
                    error = str(failure) or type(failure).__name__
                    continue
                if not check or whole(made, n):
                    break
            out.append({"text": made, "error": error if made is None else None})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return call


def attempts(build: Callable[[], Summarizer], tries: int, check: bool = True) -> Callable[[Column, Column, Column], Column]:
    """The text that `tried` gives."""
    call = tried(build, tries, check)
    return lambda prompt, text, limit: call(prompt, text, limit)["text"]


def merge_room(settings: Settings, max_tokens: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    """Tokens that numbered summaries may take in a merge request."""
    empty = templates["merge"].format(words="", text="")
    return F.lit(settings.summarization.max_context_length - len(empty) // 4 - MERGE_RESERVE) - max_tokens


def merge_batches(summaries: Column, room: Column) -> Column:
    """The texts of merge requests: numbered summaries packed in order, as many as the room allows.

    A summary's number is its place in the batch that is open when it comes: the one that
    opens a new batch carries the number that it would have had in the one before.
    """
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("done"), texts.alias("open"), F.lit(0).cast("long").alias("held"))

    def step(a: Column, s: Column) -> Column:
        entry = F.concat(F.lit("Summary "), (F.size(a["open"]) + 1).cast("string"), F.lit(":\n\n"), s)
        size = tx.tokens_estimate(entry)
        full = (a["held"] + size > room) & (F.size(a["open"]) > 0)
        return F.struct(
            F.when(full, F.array_append(a["done"], F.array_join(a["open"], "\n\n"))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(entry)).otherwise(F.array_append(a["open"], entry)).alias("open"),
            F.when(full, size).otherwise(a["held"] + size).alias("held"),
        )

    return F.aggregate(summaries, start, step, lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], F.array_join(a["open"], "\n\n"))).otherwise(a["done"]))


def summarize_chunks(docs: DataFrame, key: str, chunks: str, settings: Settings = Settings(), build: Callable[[], Summarizer] = FirstSentences, check: bool = True, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """key, summary and levels (array of level, chunk_index, summary) of each document, from its array of chunks.

    Chunks are summarised one by one, then merged level by level until one is left; if
    several are left after the last level, the first is the summary. No chunk gives an
    empty one, and so does a call that failed. Keys are unique. All levels keep the partitioning by key of the first
    grouping, and the number of levels is the logarithm of the longest document's chunks.
    """
    s = settings.summarization
    config = {"max_context": s.max_context_length, "max_summary": s.max_summary_length, "chunk_size": settings.chunking.chunk_size, "ratio": s.word_ratio}
    call = attempts(build, s.num_attempts, check)
    most = docs.agg(F.max(F.size(chunks))).first()[0] or 0
    state = docs.select(key, F.coalesce(chunks, F.array().cast("array<string>")).alias("now"))
    state = state.withColumn("lengths", chunking.level_lengths(F.size("now"), max(most, 1), **config)).withColumn("levels", F.array().cast(LEVELS))
    for level in range(len(chunking.levels(most, **config)) + 1):
        limit = F.coalesce(F.try_element_at("lengths", F.lit(level + 1)), F.lit(s.max_summary_length))
        active = F.lit(True) if level == 0 else (F.size("now") > 1) & (F.size("lengths") >= level)
        todo = F.col("now") if level == 0 else F.when(active, merge_batches(F.col("now"), merge_room(settings, limit, templates))).otherwise(F.col("now"))
        each = state.select(key, "lengths", "levels", active.alias("active"), limit.alias("limit"), F.posexplode_outer(todo).alias("pos", "text"))
        prompt = F.when(F.col("active") & F.col("text").isNotNull(), chunk_prompt(F.col("text"), words_for(F.col("limit"), s.word_ratio), level, None, templates))
        made = each.withColumn("made", call(prompt, F.col("text"), F.col("limit"))).withColumn("summary", F.when(F.col("active"), F.coalesce("made", F.lit(""))).otherwise(F.col("text")))
        item = F.when(F.col("pos").isNotNull(), F.struct("pos", "summary"))
        state = made.groupBy(key).agg(F.first("lengths").alias("lengths"), F.first("levels").alias("levels"), F.first("active").alias("active"), F.array_sort(F.collect_list(item)).alias("items"))
        number = F.lit(level).alias("level")
        entries = F.transform("items", lambda x: F.struct(number, x["pos"].alias("chunk_index"), x["summary"].alias("summary")))  # noqa: B023
        state = state.select(key, "lengths", F.transform("items", lambda x: x["summary"]).alias("now"), F.when(F.col("active"), F.concat("levels", entries)).otherwise(F.col("levels")).alias("levels"))
    return state.select(key, F.coalesce(F.try_element_at("now", F.lit(1)), F.lit("")).alias("summary"), "levels")


LEVELS = "array<struct<level:int,chunk_index:int,summary:string>>"


def _level(spark: SparkSession, path: str) -> DataFrame | None:
    """A level's table, if its writer has left its mark."""
    return spark.read.parquet(path) if path_exists(spark, f"{path}/_SUCCESS") else None


def summarize_by_level(docs: DataFrame, key: str, chunks: str, folder: str, settings: Settings = Settings(), build: Callable[[], Summarizer] = FirstSentences, check: bool = True, templates: dict[str, str] = TEMPLATES, stop_after: int | None = None) -> DataFrame | None:
    """As summarize_chunks, with a written table for each level: key, lengths, chunk_index, summary and error.

    A level holds the documents that still had several summaries, and is made from the level
    before it, so each chunk and each merge is called once. A run that was stopped goes on after
    the last level that is there; one that had ended is read. The result (key, summary, levels)
    and the errors of failed calls stay in the folder, the levels go. A failed call keeps its
    document: its summary is empty. stop_after: ends the call after that level, as an
    interruption would, and gives nothing.
    """
    spark, s = docs.sparkSession, settings.summarization
    done = _level(spark, f"{folder}/summaries")
    if done is not None:
        return done
    config = {"max_context": s.max_context_length, "max_summary": s.max_summary_length, "chunk_size": settings.chunking.chunk_size, "ratio": s.word_ratio}
    call, none = tried(build, s.num_attempts, check), F.array().cast("array<string>")
    at = lambda level: f"{folder}/frontier/{level}"

    def written(opened: DataFrame, texts: Column, level: int) -> DataFrame:
        limit = F.coalesce(F.try_element_at("lengths", F.lit(level + 1)), F.lit(s.max_summary_length))
        each = opened.select(key, "lengths", limit.alias("limit"), F.posexplode_outer(texts).alias("chunk_index", "text"))
        prompt = F.when(F.col("text").isNotNull(), chunk_prompt(F.col("text"), words_for(F.col("limit"), s.word_ratio), level, None, templates))
        made = each.withColumn("made", call(prompt, F.col("text"), F.col("limit")))
        made.select(key, "lengths", "chunk_index", F.coalesce("made.text", F.lit("")).alias("summary"), "made.error").write.mode("overwrite").parquet(at(level))
        return spark.read.parquet(at(level))

    level, now = 0, _level(spark, at(0))
    if now is None:
        state = docs.select(key, F.coalesce(chunks, none).alias("now"))
        most = state.agg(F.max(F.size("now"))).first()[0] or 0
        now = written(state.withColumn("lengths", chunking.level_lengths(F.size("now"), max(most, 1), **config)), F.col("now"), 0)
    while stop_after is None or level < stop_after:
        level += 1
        grouped = now.groupBy(key).agg(F.first("lengths").alias("lengths"), F.array_sort(F.collect_list(F.struct("chunk_index", "summary"))).alias("items"))
        opened = grouped.where((F.size("items") > 1) & (F.size("lengths") >= level))
        if not opened.take(1):
            break
        held = _level(spark, at(level))
        limit = F.coalesce(F.try_element_at("lengths", F.lit(level + 1)), F.lit(s.max_summary_length))
        now = held if held is not None else written(opened, merge_batches(F.transform("items", lambda x: x["summary"]), merge_room(settings, limit, templates)), level)
    else:
        return None
    tables = [spark.read.parquet(at(k)).select("*", F.lit(k).alias("level")) for k in range(level)]
    rows = reduce(DataFrame.unionByName, tables)
    rows.where(F.col("error").isNotNull()).select(key, "level", "chunk_index", "error").write.mode("overwrite").parquet(f"{folder}/errors")
    entry = F.when(F.col("chunk_index").isNotNull(), F.struct("level", "chunk_index", "summary"))
    best = F.max_by("summary", F.struct("level", -F.coalesce("chunk_index", F.lit(0))))  # the first of the last level
    found = rows.groupBy(key).agg(best.alias("summary"), F.array_sort(F.collect_list(entry)).cast(LEVELS).alias("levels"))
    found.write.mode("overwrite").parquet(f"{folder}/summaries")
    delete(spark, f"{folder}/frontier")
    return spark.read.parquet(f"{folder}/summaries")


def level_rows(summarized: DataFrame, key: str) -> DataFrame:
    """key, level, chunk_index and summary of all levels."""
    return summarized.select(key, F.explode("levels").alias("x")).select(key, "x.*")


def write_levels(summarized: DataFrame, key: str, path: str) -> None:
    """The summaries of all levels as CSV."""
    write_csv(level_rows(summarized, key), path, backslash=True)


def release_input(prompt: Column, summary: Column, context: int, most: int = RELEASE_TOKENS) -> Column:
    """Prompt and summary as one request; the summary is cut where both don't fit beside the answer."""
    joined = F.concat(prompt, F.lit("\n\n"), summary)
    room = F.greatest(F.lit(context - most - RELEASE_RESERVE) - tx.tokens_estimate(prompt), F.lit(0))
    cut = F.concat(prompt, F.lit("\n\n"), F.substring(summary, F.lit(1), (4 * room).cast("int")))
    return F.when(tx.tokens_estimate(joined) > context - most, cut).otherwise(joined)


def releases(df: DataFrame, prompt: str, summary: str, out: str, settings: Settings = Settings(), build: Callable[[], Summarizer] = FirstSentences, most: int = RELEASE_TOKENS) -> DataFrame:
    """df with the final text made from prompt and hierarchical summary; a failed call, or a null in either, gives an empty text."""

    @F.arrow_udf(StringType())
    def call(request: pa.Array) -> pa.Array:
        model, made = build(), []
        for r in request.to_pylist():
            try:
                made.append(model.summarize(r, r, most) if r is not None else "")
            except Exception:  # one text less is better than none
                made.append("")
        return pa.array(made, pa.string())

    return df.withColumn(out, call(release_input(F.col(prompt), F.col(summary), settings.summarization.max_context_length, most)))


def with_chunks(df: DataFrame, settings: Settings = Settings(), out: str = "chunks") -> DataFrame:
    """The table with chunks of its text column."""
    return df.withColumn(out, chunking.chunks(F.coalesce(F.col(settings.columns.text), F.lit("")), settings.chunking.chunk_size))


def run_chunking(df: DataFrame, settings: Settings = Settings(), out: str = "chunks") -> tuple[DataFrame, DataFrame]:
    """The table with chunks of its text column, and one row (chunks, least, most, mean, median) of their token counts."""
    made = with_chunks(df, settings, out)
    return made, chunk_stats(made, out)


def chunk_stats(made: DataFrame, chunks: str) -> DataFrame:
    """One row (chunks, least, most, mean, median) of the token counts of all chunks."""
    n = settled(made.select(F.explode(chunks).alias("c")).select(tx.tokens_estimate(F.col("c")).alias("n")))
    stats = n.agg(F.count("*").alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    return stats.join(quantiles(n, "n", {"median": 0.5}), F.lit(True), "left")  # one row each


def run(df: DataFrame, model: str, settings: Settings = Settings(), build: Callable[[], Summarizer] = FirstSentences, check: bool = True, folder: str | None = None) -> DataFrame:
    """id and `model`: chunks, hierarchical summary and final release of each row; its levels are written to folder, or else to scratch. Ids are unique."""
    c = settings.columns
    chunked = with_chunks(df.select(c.id, c.text), settings)
    summarized = summarize_by_level(chunked, c.id, "chunks", folder or scratch(df.sparkSession), settings, build, check).select(c.id, F.col("summary").alias("_summary"))
    made = releases(df.select(c.id, c.prompt).join(summarized, c.id), c.prompt, "_summary", model, settings, build)
    return made.select(c.id, model)


def run_aggregation(outputs: list[DataFrame], original: DataFrame | None = None, key: str = "id") -> DataFrame:
    """One table with the output columns of all models, at the ids of the original table or else of the first output."""
    base, *others = [original, *outputs] if original is not None else outputs
    return coalesce_merge(base, others, key)
