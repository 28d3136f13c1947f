"""Fill-in-middle: a text cut at two places and put together with its middle last.

Only DataFrame functions. A delimiter is escaped in the text, `regexp_replace` puts it after
each unit, the delimiters are counted, and `substring_index` takes the parts between the
ranked ones; each part is freed of delimiters and unescaped. Nothing is shuffled.

The two cuts, the form and the order come from a digest of seed and id, so they are the same
wherever and whenever a row is worked on. Null texts are empty texts. Empty texts, and texts
that hold one of the marks, stay plain: they could not be taken apart again. A null id is
hashed like an empty one. Repeated rows give repeated results; very long texts are worked on
whole, at some ten times their size in memory; columns other than id and text are left out,
so none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: The delimiter, the escape sign and what follows it for each of the two.
_CUT, _ESCAPE, _IS_CUT, _IS_ESCAPE = "\u0001", "\u0002", "\u0003", "\u0004"
#: A unit of one code point; an escaped one counts as one.
CODE_POINT = r"\x02?."


def escaped(text: Column) -> Column:
    """The text without the delimiter."""
    text = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _IS_ESCAPE))
    return F.replace(text, F.lit(_CUT), F.lit(_ESCAPE + _IS_CUT))


def unescaped(text: Column) -> Column:
    """The text that `escaped` was given, of a part or the whole, once its delimiters are taken away."""
    text = F.replace(text, F.lit(_CUT), F.lit(""))
    text = F.replace(text, F.lit(_ESCAPE + _IS_CUT), F.lit(_CUT))
    return F.replace(text, F.lit(_ESCAPE + _IS_ESCAPE), F.lit(_ESCAPE))


def marked(text: Column, unit: str = CODE_POINT) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), f"(?s){unit}", f"$0{_CUT}")


def units(text: Column, cut: Column) -> Column:
    """How many units a text has, by the delimiters (of a byte each) that its marked form has gained."""
    return (F.octet_length(cut) - F.octet_length(escaped(text))).cast("long")


def ranked(cut: Column, rank: Column) -> Column:
    """What stands before (rank above 0) or behind (below 0, counted from the right) the delimiter of a rank; all of it if there is none such."""
    return F.call_function("substring_index", cut, F.lit(_CUT), rank.cast("int"))


def parts(cut: Column, n: Column, low: Column, high: Column) -> dict[str, Column]:
    """The units before low, from low to under high, and all from high on, of a marked text of n units; what stands behind the last unit is the suffix's."""
    return {
        "prefix": unescaped(ranked(cut, low)),
        "middle": unescaped(ranked(ranked(cut, high), low - high)),
        "suffix": unescaped(ranked(cut, high - n - 1)),
    }


def draws(id_column: str, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    p, s, m = map(F.lit, marks)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. Texts hold no mark, so each stands once in the output."""
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: str = "1", rate: int = 90, spm: int = 20, unit: str = CODE_POINT, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """id, text, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain) and output of each row.

    rate: percent of the texts that are cut; spm: percent of those that begin with the suffix.
    unit: a regular expression that never matches nothing; `\\S+\\s*` cuts between words. It sees
    a U+0001 or U+0002 of the text as two signs, U+0002 and U+0003 or U+0004.
    """
    h1, h2, h3, h4 = draws(id_column, seed)
    rows = docs.select(F.col(id_column), F.coalesce(text_column, F.lit("")).alias("text"))
    rows = rows.withColumn("_cut", marked(F.col("text"), unit)).withColumn("n", units(F.col("text"), F.col("_cut")))
    whole = (F.col("n") == 0) | (h3 % 100 >= rate)
    for mark in marks:
        whole = whole | F.contains("text", F.lit(mark))
    cut, n = F.col("_cut"), F.col("n")
    low, high = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))
    rows = rows.withColumn("form", F.when(whole, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))
    rows = rows.withColumns({c: F.when(F.col("form") != "plain", p) for c, p in parts(cut, n, low, high).items()})
    output = F.coalesce(assembled(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), marks), F.col("text"))
    return rows.select(id_column, "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def digest(done: DataFrame, id_column: str = "doc_id", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """id, n, form, code points of prefix and middle, digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    size = lambda c: F.length(c).cast("long")
    return done.select(
        id_column, "n", "form", size(F.col("prefix")).alias("prefix_chars"), size(F.col("middle")).alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"),
    )
