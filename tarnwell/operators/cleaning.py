"""Validation, cleaning and rule flags of text tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import text as tx
from tarnwell.sources.scratch import settled

# Phrase lists, date patterns and labels of the announcement rule.
HEADLINES = [
    "presseinformation", "information für die presse", "medieninformation", "zur information", "terminvorschau", "jahresbericht", "geschäftsbericht",
    "tätigkeitsbericht", "stellenausschreibung", "personelle veränderungen", "neuer präsident", "akkreditierung", "sehr geehrt",
]
KEYWORDS = [
    "ankündigung", "terminankündigung", "terminhinweis", "hinweis auf termin", "wird verhandelt", "wird verhandeln", "wird.*stattfinden", "findet statt", "einladung", "pressetermin",
    "pressekonferenz", "veranstaltung", "wochenvorschau", "jahrespressekonferenz", "pressegespräch", "rundgang", "beginnt am", "laden ein", "lädt ein", "sitzung vom",
]
DATE_PATTERNS = [
    r"am\s+(\d{1,2})\.(\d{1,2})\.(\d{4})",
    r"am\s+(\d{1,2})\.(\d{1,2})\.()",
    r"vom\s+(\d{1,2})\.(\d{1,2})\.(\d{4})?",
    r"terminiert auf den (\d{1,2})\.(\d{1,2})\.(\d{4})?",
    r"findet\s+am\s+(\d{1,2})\.(\d{1,2})\.(\d{4})?\s+statt",
    r"verhandelt\s+am\s+(\d{1,2})\.(\d{1,2})\.(\d{4})?",
]
PERIODS = ["in der kommenden woche", "in der nächsten woche", "demnächst"]
HEADLINE_CHARS = 500
REQUIRED = ["id", "date", "summary", "judgement", "subset_name", "split_name", "is_announcement_rule", "matching_criteria", "synthetic_prompt"]
IMPORTANT = ["id", "summary", "judgement", "synthetic_prompt"]
KEPT = ["id", "summary", "judgement"]
NORMAL_LENGTH = 100_000
# End of fixed values.


def row_ids(df: DataFrame, order: list[str | Column], name: str = "_row_id") -> DataFrame:
    """A contiguous row number from 0 in the given order.

    Rows are numbered within ranges of the order, and each range is moved by the number of
    rows before it, so that no single task sees all rows. The ranges are written once: their
    bounds come from a sample, and a second one would cut them elsewhere.
    """
    spread = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    placed = spread.join(F.broadcast(before.select("_p", "_first", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p")
    return placed.withColumn(name, F.col("_m") - F.col("_first") + F.col("_before")).drop("_p", "_m", "_first", "_before")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def fill_absent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds absent columns as empty text."""
    return df.withColumns({c: F.lit("") for c in missing_columns(df, columns)})


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def audit(df: DataFrame, id_column: str, important: list[str], prompt: str | None, phrases: list[str] = tx.ERROR_PHRASES, normal: int = NORMAL_LENGTH) -> DataFrame:
    """check, subject, found: one row for each defect count of the table, zero included, in one pass (and one for ids)."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    count = lambda cond: F.sum(cond.cast("long"))
    checks = [("missing", c, count(blank(F.col(c).cast("string")))) for c in important]
    if prompt is not None:
        checks += [("phrase", p, count(F.coalesce(F.col(prompt).contains(p), F.lit(False)))) for p in phrases]
    checks += [("nul", c, count(F.coalesce(F.col(c).contains("\0"), F.lit(False)))) for c in texts]
    checks += [("too_long", c, F.greatest(F.max(F.length(c)) - normal, F.lit(0)).cast("long")) for c in texts]
    row = df.agg(*[v.alias(f"v{i}") for i, (_, _, v) in enumerate(checks)])
    made = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(s).alias("subject"), F.coalesce(f"v{i}", F.lit(0)).cast("long").alias("found")) for i, (k, s, _) in enumerate(checks)])).alias("c")).select("c.*")
    repeated = df.groupBy(id_column).count().where("count > 1 ").agg(F.count("*").alias("found"))
    return made.union(repeated.select(F.lit("repeated_ids"), F.lit(id_column), F.col("found").cast("long")))


def validate(df: DataFrame) -> tuple[bool, list[str]]:
    """Whether the canonical table is sound, and what is wrong: columns, repeated ids, missing values, phrases, NUL, lengths."""
    if absent := missing_columns(df, REQUIRED):
        return False, [f"Missing columns: {', '.join(absent)}"]
    errors = []
    ids = [r[0] for r in df.groupBy("id").count().where("count > 1").select("id").orderBy("id").limit(1000).collect()]
    if ids:
        errors.append(f"Duplicate ids: {ids}")
    for check, subject, found in audit(df, "id", IMPORTANT, "synthetic_prompt").where("found > 0 AND check <> 'repeated_ids'").collect():
        errors.append({"missing": f"Missing values in {subject}: {found}", "phrase": f"Error phrase {subject!r}: {found} rows", "nul": f"NUL characters in {subject}: {found} rows", "too_long": f"Unusually long text in {subject}: {found} characters over"}[check])
    return not errors, errors


def clean(df: DataFrame, id_column: str, order: str, kept: list[str], prompt: str | None, phrases: list[str] = tx.ERROR_PHRASES) -> DataFrame:
    """First row of each id in the given order, then no error phrase in the prompt, then all kept columns filled."""
    first = Window.partitionBy(id_column).orderBy(order)
    out = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if prompt is not None:
        out = out.where(~tx.any_contains(F.col(prompt), phrases))
    for c in kept:
        out = out.where(~blank(F.col(c).cast("string")))
    return out


def verdicts(df: DataFrame, file: str, prompt: str, filled: list[str], phrases: list[str] = tx.ERROR_PHRASES) -> DataFrame:
    """file, ok, valid and message of each file of prompts: error phrases first, then missing values."""
    has = tx.any_contains(F.col(prompt), phrases)
    empty = F.lit(False)
    for c in filled:
        empty = empty | blank(F.col(c).cast("string"))
    n = lambda c: F.sum(c.cast("long"))
    found = df.groupBy(file).agg(n(has).alias("phrases"), n(empty).alias("missing"), n(~has & ~empty).alias("valid"))
    message = F.when(F.col("phrases") > 0, F.concat(F.col("phrases").cast("string"), F.lit(" rows with error phrases"))).when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" rows with missing values")))
    return found.select(file, message.isNull().alias("ok"), "valid", F.coalesce(message, F.lit("sound")).alias("message"))


def phrase_audit(df: DataFrame, columns: list[str], phrases: list[str]) -> DataFrame:
    """column, phrase, rows: how many rows of a column have a phrase, where any has."""
    pairs = [(c, p) for c in columns for p in phrases]
    row = df.agg(*[F.sum(F.coalesce(F.col(c).cast("string").contains(p), F.lit(False)).cast("long")).alias(f"v{i}") for i, (c, p) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("phrase"), F.coalesce(f"v{i}", F.lit(0)).cast("long").alias("rows")) for i, (c, p) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*").where("rows > 0")


def reset_failed(df: DataFrame, prompt: str, phrases: list[str] = tx.ERROR_PHRASES) -> DataFrame:
    """Prompts with an error phrase become null, to be made again."""
    return df.withColumn(prompt, F.when(~tx.any_contains(F.col(prompt), phrases), F.col(prompt)))


def to_do(df: DataFrame, prompt: str, row_id: str, start: int) -> DataFrame:
    return df.where((F.col(row_id) >= start) & F.col(prompt).isNull())


def carry_over(df: DataFrame, done: DataFrame, row_id: str, prompt: str, start: int) -> DataFrame:
    """Prompts of an earlier run for the rows before start; of several for one id the smallest."""
    old = done.where(F.col(row_id) < start).groupBy(row_id).agg(F.min(prompt).alias("_old"))
    return df.join(old, row_id, "left").withColumn(prompt, F.coalesce("_old", prompt)).drop("_old")


def drop_after_hit(lines: DataFrame, number: str, line: str, phrases: list[str], file: str | None = None) -> DataFrame:
    """Line filter for unreadable files: a line with a phrase goes, and so does the line after it.

    A line that goes because of the one before can't take a further line along, so in a
    run of hits every second one counts: places in the run decide. file: a column that
    tells files apart; each is ordered by itself. Without it the lines are one file's,
    which is read in order by one task.
    """
    hit = lines.withColumn("_hit", tx.any_contains(F.col(line), phrases))
    files = [file] if file else []
    by = Window.partitionBy(*files).orderBy(number)
    run = hit.withColumn("_run", F.sum((~F.col("_hit")).cast("long")).over(by)).withColumn("_at", F.row_number().over(Window.partitionBy(*files, "_run", "_hit").orderBy(number)))
    marked = run.withColumn("_after", F.lag(F.col("_hit") & (F.col("_at") % 2 == 1), 1, False).over(by))
    return marked.where(~F.col("_hit") & ~F.col("_after")).select(*lines.columns)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def days_ahead(match: Column, pattern: str, day: Column) -> Column:
    """Days from day to the date (day, month and perhaps year) of a match of a date pattern; null if it is none."""

    def of(x: Column) -> Column:
        d, m, y = x["d"], x["m"], x["y"]
        sound = d.between(1, 31) & m.between(1, 12) & y.between(1900, 2100)
        return F.datediff(F.when(sound, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d))), day)

    group = lambda k: F.nullif(F.regexp_extract(match, pattern, k), F.lit("")).cast("int")
    return bound(F.struct(group(1).alias("d"), group(2).alias("m"), F.coalesce(group(3), F.year(day)).alias("y")), of)


def _literal(phrase: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", phrase)


def announcement(summary: Column, published: Column | None = None, headlines: list[str] = HEADLINES, keywords: list[str] = KEYWORDS, dates: list[str] = DATE_PATTERNS, periods: list[str] = PERIODS) -> Column:
    """A struct (flag, criteria): a headline phrase early on, or a keyword together with a future date or period.

    All lists are parameters; periods are patterns, keywords are literal phrases between
    word boundaries. A text is searched once for all phrases of a list; only where there is
    one is it asked which, and dates and periods are looked for only where a headline or
    keyword lets them count.
    """
    none = F.array().cast("array<string>")
    some = lambda gate, found: F.when(gate, found).otherwise(none)
    named = lambda cases: F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in cases]))
    any_of = lambda text, patterns, flags="": text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))
    label = lambda xs, name: F.transform(xs, lambda x: F.concat(F.lit(f"{name}: "), x))

    def phrases(low: Column) -> Column:
        start = F.substring(low, 1, HEADLINE_CHARS)
        h = some(any_of(start, map(_literal, headlines)), named([(start.contains(p), p) for p in headlines])) if headlines else none
        k = some(any_of(low, map(_literal, keywords)), named([(low.contains(p) & low.rlike(tx.bounded(p)), p) for p in keywords])) if keywords else none
        day = F.try_to_date(published.cast("string")) if published is not None else F.lit(None).cast("date")
        return bound(F.struct(low.alias("low"), h.alias("h"), k.alias("k"), day.alias("day")), times)

    def times(x: Column) -> Column:
        low, counts = x["low"], (F.size(x["h"]) > 0) | (F.size(x["k"]) > 0)
        p = some(counts & any_of(low, periods, "(?i)"), named([(low.rlike(f"(?i){p}"), p) for p in periods])) if periods else none
        d = none
        if published is not None and dates:
            d = some(counts & any_of(low, dates, "(?U)"), F.concat(*[ahead(low, f"(?U){pattern}", x["day"]) for pattern in dates]))
        return bound(F.struct(x["h"].alias("h"), x["k"].alias("k"), d.alias("d"), p.alias("p")), verdict)

    def ahead(low: Column, pattern: str, day: Column) -> Column:
        each = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("all"), days_ahead(m, pattern, day).alias("n")))
        return F.transform(F.filter(each, lambda x: F.coalesce(x["n"] >= 1, F.lit(False))), lambda x: F.concat(F.lit("Datum: "), x["all"], F.lit(" (+"), x["n"].cast("string"), F.lit(" Tage)")))

    def verdict(x: Column) -> Column:
        future = (F.size(x["d"]) > 0) | (F.size(x["p"]) > 0)
        flag = (F.size(x["h"]) > 0) | ((F.size(x["k"]) > 0) & future)
        criteria = F.concat_ws(" | ", F.concat(label(x["h"], "Headline"), label(x["k"], "Keyword"), x["d"], label(x["p"], "Zeitraum")))
        return F.struct(flag.alias("flag"), F.when(flag, criteria).alias("criteria"))

    return bound(F.lower(F.coalesce(summary, F.lit(""))), phrases)


def split_by_flag(df: DataFrame, flag: str) -> DataFrame:
    """The table with its status: removed where the flag holds, else cleaned."""
    return df.withColumn("status", F.when(F.coalesce(F.col(flag), F.lit(False)), "removed").otherwise("cleaned"))


def criteria_histogram(df: DataFrame, criteria: str) -> DataFrame:
    """criterion, kind and count of all criteria."""
    each = df.where(F.col(criteria).isNotNull()).select(F.explode(F.split(criteria, r" \| ")).alias("criterion"))
    return each.groupBy("criterion").agg(F.count("*").alias("n")).withColumn("kind", F.substring_index("criterion", ":", 1))
