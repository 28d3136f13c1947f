"""Prompt synthesis and training rows: resumable generation, repair of prompt tables, stand-in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import text as tx
from tarnwell.functions.adapters import Ask, ModelConfig, answered
from tarnwell.operators.cleaning import REQUIRED, carry_over, drop_after_hit, reset_failed
from tarnwell.operators.selection import exact_split
from tarnwell.sources.scratch import settled
from tarnwell.sources.tables import header_of, read_arity, read_csv, read_lines, read_tolerant, write_csv

#: Characters of a ruling and of a release that a request holds.
RULING_CHARS, PRESS_CHARS = 12_000, 4_000


def request(ruling, press):
    """The text that asks for a prompt: both sides within their limits."""
    return F.concat(F.lit("Pressemitteilung:\n"), tx.shorten(press, PRESS_CHARS), F.lit(f"\n\n{tx.RULING_MARK}\n"), tx.shorten(ruling, RULING_CHARS))


def synthesize(df: DataFrame, row_id: str, ruling: str, press: str, prompt: str, config: ModelConfig, done: DataFrame | None = None, start: int = 0, ask: Ask = answered) -> DataFrame:
    """The table with prompts: those of an earlier run before start are carried over, failed ones are made again, missing ones from start on are made.

    Rows go through the call with all their columns, so null and repeated ids are rows like any
    others; a row without an id is never before start.
    """
    names = df.columns
    if prompt not in names:
        df, names = df.withColumn(prompt, F.lit(None).cast("string")), [*names, prompt]
    if done is not None:
        df = carry_over(df, done, row_id, prompt, start)
    df = reset_failed(df, prompt)
    missing = F.coalesce(F.col(row_id) >= start, F.lit(True)) & F.col(prompt).isNull()
    made = ask(df, config, F.col(ruling), request(F.col(ruling), F.col(press)), "_made", "_error", missing)
    new = tx.sanitize(F.coalesce("_made", F.concat(F.lit("API-Fehler: "), F.coalesce("_error", F.lit("?")))))
    return made.withColumn(prompt, F.when(missing, new).otherwise(F.col(prompt))).select(*names)


def sanitized(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The table with sanitized answers, and one row (changed, filled) with the counts. Nulls stay null."""
    clean = F.when(F.col(column).isNotNull(), tx.sanitize(F.col(column)))
    counts = df.agg(F.sum((~clean.eqNullSafe(F.col(column))).cast("long")).alias("changed"), F.count(column).alias("filled"))
    return df.withColumn(column, clean), counts


def repaired(spark: SparkSession, path: str, header_only: bool = False, default: list[str] = REQUIRED) -> DataFrame:
    """A broken CSV as a table: strict reading, else rows that fit the header, else no row and the default header."""
    try:
        strict = read_csv(spark, path, mode="FAILFAST")
        strict.write.format("noop").mode("overwrite").save()
        return strict.limit(0) if header_only else strict
    except Exception:  # any defect: the next way is more patient
        try:
            df = read_tolerant(spark, path, exact=True)
            return df.limit(0) if header_only else df
        except Exception:
            return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in default))


def fix_format(spark: SparkSession, path: str, out: str) -> int:
    """Writes the records of a CSV that fit its header, all cells quoted; the number of rows written."""
    df = settled(read_arity(spark, path))
    write_csv(df, out, backslash=True)
    return df.count()


def clean_prompts(spark: SparkSession, path: str, prompt: str, phrases: list[str] = tx.ERROR_PHRASES) -> DataFrame:
    """The rows of a CSV whose prompt has no error phrase; of a file that can't be read so, the lines that are left by the line filter."""
    if prompt in header_of(spark, path):
        return read_tolerant(spark, path).where(~tx.any_contains(F.coalesce(prompt, F.lit("")), phrases))
    return drop_after_hit(read_lines(spark, path), "number", "line", phrases, "file").select("line")


def ordered_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns in their order, then all others."""
    known = [c for c in first if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def mock_columns(df: DataFrame, key: str, names: list[str], least: int = 300, most: int = 600) -> DataFrame:
    """Stand-in outputs of models that the table lacks: texts of least to most characters from a hash of key and name."""

    def filler(name: str):
        seed = F.concat(F.col(key).cast("string"), F.lit(f"/{name}/"))
        blocks = F.transform(F.sequence(F.lit(0), F.lit(most // 64)), lambda i: F.sha2(F.concat(seed, i.cast("string")), 256))
        size = F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long") % (most - least + 1) + least
        return F.substring(F.array_join(blocks, ""), F.lit(1), size.cast("int"))

    return df.withColumns({name: filler(name) for name in names if name not in df.columns})


def training_rows(df: DataFrame, key: str, prompt: str, ruling: str, summary: str, train: float = 0.9, split: str | None = None) -> DataFrame:
    """key, split, prompt, completion: by the split column where there is one, else the int(rows * train) rows of the smallest hashes are for training."""
    rows = df.withColumn("split", F.col(split)) if split else exact_split(df, key, train)
    return rows.select(key, "split", F.concat(F.lit("User: "), tx.prompt(F.col(prompt), F.col(ruling)), F.lit("\n\nAssistant: ")).alias("prompt"), F.col(summary).alias("completion"))
