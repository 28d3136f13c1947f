"""Column functions over texts: tokens, overlaps, flags, templates, sanitizing, parsing."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Phrases, patterns and limits that results depend on.
ERROR_PHRASES = ["API-Fehler", "Your credit balance is too low", "invalid_request_error", "Fehler bei der Generierung des Prompts"]
ERROR_MARKS = ["Fehler bei der Generierung des Prompts", "API-Fehler", "Your credit balance is too low", "invalid_request_error", "Fehler:", "Error:", "Exception:"]
JSON_ERROR_PATTERNS = [r'\{"error":.+\}', r'"status":\s*(?:4|5)\d{2}', r'"message":\s*"[^"]*error[^"]*"']
META_PREFIXES = ["Hier ist der Prompt:?", "Here is the prompt:?", "The prompt would be:?", "Folgender Prompt könnte verwendet werden:?"]
FAILED = "Fehler bei der Generierung des Prompts: "
FAILURES = {"pattern": "Fehlermuster erkannt", "code": "API-Fehlercode erkannt", "short": "Antwort zu kurz", "special": "Ungewöhnlich hoher Anteil an Sonderzeichen"}
STOP_WORDS = [
    "der", "die", "das", "und", "in", "zu", "den", "mit", "von", "für", "auf", "im", "nicht", "ein", "eine",
    "ist", "es", "an", "dass", "sich", "bei", "als", "nach", "auch", "vor", "durch", "zum", "zur", "aus", "über",
]
#: Before a blank or line break after a mark, or a blank after a mark and a quote.
BOUNDARY = r'(?=(?<=[.?!])[ \n]|(?<=[.?!]") )'
OUTPUT_ENDINGS = ["_gen_hier_summary", "_generated_judgement_summary"]
PLACE_WORDS = ["stadt", "land", "bundesland", "gericht"]
RULING_MARK = "Gerichtsurteil:"
CLAIM_BREAK = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"
JUDGE_FIELDS = ["faktische_korrektheit", "vollständigkeit", "klarheit", "struktur", "vergleich_mit_referenz"]
# End of fixed values.

WORD = r"[\p{L}\p{N}_]"
#: The letters of most words as a class within a class: it is looked at first and takes no look at Unicode.
LOWER = "[abcdefghijklmnopqrstuvwxyz]"
#: A letter of more than 16 bits: with one in it, Java's look behind goes by whole characters.
BEYOND = "\U00010000"
WHITE = r"(?U)\s+"
#: What stands between WHITE, for RE2.
PIECE = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: All characters that count as white space: those of Unicode and the four separators of ASCII.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def bounded(phrase: str) -> str:
    """A pattern for the literal phrase between word boundaries."""
    return rf"(?<!{WORD})\Q{phrase}\E(?!{WORD})"


def strip(text: Column) -> Column:
    """The text without white space at both ends, as Python strips it."""
    return F.btrim(text, F.lit(SPACES))


def any_contains(text: Column, phrases: list[str]) -> Column:
    """Whether the text has one of the phrases; null has none."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | text.contains(phrase)
    return F.coalesce(out, F.lit(False))


def tokens_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def shorten(text: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def prompt(instruction: Column, ruling: Column) -> Column:
    return F.concat(instruction, F.lit(f"\n\n{RULING_MARK} "), ruling)


def generated_part(full: Column, given: Column) -> Column:
    """Model output without the echoed input: what follows it, else what follows the first blank line after the last mark, else all."""
    after = F.substring_index(full, RULING_MARK, -1)
    blank = F.locate("\n\n", after)
    return (
        F.when(full.startswith(given), strip(F.substring(full, F.length(given) + 1, F.length(full))))
        .when(full.contains(RULING_MARK) & (blank > 0), strip(F.substring(after, blank + 2, F.length(after))))
        .otherwise(strip(full))
    )


def words(text: Column) -> Column:
    """Lower-cased words without digits and marks; an underscore stays."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{LOWER}\p{{L}}\p{{Nl}}\p{{No}}_]++"), F.lit(0))


def plain_words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def capitalised(text: Column) -> Column:
    """Different tokens of ASCII letters that start with a capital."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"[A-Z](?<![\p{{L}}\p{{N}}_{BEYOND}][A-Z])[a-zA-Z]*+(?!{WORD})"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def entity_overlap(reference: Column, generated: Column) -> Column:
    return jaccard(capitalised(reference), capitalised(generated))


@F.arrow_udf(IntegerType())
def piece_count(text: pa.Array) -> pa.Array:
    """The number of plain_words."""
    return pc.cast(pc.count_substring_regex(text, PIECE), pa.int32())


def length_ratio(reference: Column, generated: Column) -> Column:
    """Shorter over longer word count; 0 if either has no word."""
    a, b = piece_count(reference), piece_count(generated)
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def precision_recall(reference: Column, generated: Column) -> Column:
    """A struct (precision, recall, f1) of two arrays as sets: two empty ones agree, one empty one agrees in nothing."""
    both = F.size(F.array_intersect(reference, generated))
    a, b = F.size(F.array_distinct(reference)), F.size(F.array_distinct(generated))
    p = F.when((a == 0) & (b == 0), 1.0).when(b == 0, 1.0).when(a == 0, 0.0).otherwise(both / b)
    r = F.when((a == 0) & (b == 0), 1.0).when(b == 0, 0.0).when(a == 0, 1.0).otherwise(both / a)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def text_stats(text: Column) -> Column:
    """A struct (chars, words, sentences); null has none."""
    t = F.coalesce(text, F.lit(""))
    sentences = F.filter(F.split(t, r"\."), lambda s: strip(s) != "")
    return F.struct(F.length(t).cast("long").alias("chars"), F.size(plain_words(t)).cast("long").alias("words"), F.size(sentences).cast("long").alias("sentences"))


def structure(text: Column) -> Column:
    """Flags (has_date, has_location, has_quotes, starts_with_date); null has none."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(
        F.substring(t, 1, 50).rlike(r"\p{Nd}").alias("has_date"),
        any_contains(F.lower(t), PLACE_WORDS).alias("has_location"),
        any_contains(t, ['"', "''"]).alias("has_quotes"),
        t.rlike(r"^\p{Nd}").alias("starts_with_date"),
    )


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), strip), lambda s: s != "")


def claims(text: Column, most: int = 5, least_words: int = 5) -> Column:
    """The first sentences of least_words words or more."""
    pieces = F.transform(F.split(text, CLAIM_BREAK), strip)
    return F.slice(F.filter(pieces, lambda s: F.size(plain_words(s)) >= least_words), 1, most)


def questions(text: Column, most: int = 5) -> Column:
    """The first lines that end in a question mark and have three words or more."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.slice(F.filter(lines, lambda s: s.contains("?") & (F.size(plain_words(s)) >= 3)), 1, most)


def annotation_flag(kind: str, value: Column) -> Column:
    """A flag from an annotator's wording, by substring; null is false."""
    marks = {"hallucination": ["hallucination", "outside of case"], "incoherent": ["incoherent"], "publishable": ["publishable"]}
    return any_contains(F.lower(value), marks.get(kind, []))


def judge_scores(answer: Column) -> Column:
    """A struct of the judge's five values and total from the text between the first and last brace; null fields where it can't be read."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    schema = ", ".join(f"`{f}` struct<wert:double>" for f in JUDGE_FIELDS) + ", gesamtscore double"
    read = F.from_json(body, schema)
    return F.struct(*[read[f]["wert"].alias(f) for f in JUDGE_FIELDS], read["gesamtscore"].alias("gesamtscore"))


def special_share(text: Column) -> Column:
    """Share of characters that are neither letters, numbers nor white space."""
    return F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", "")) / F.length(text)


def sanitize(answer: Column, least: int = 10, most: int = 5000, special: float = 0.3) -> Column:
    """A model's answer without wrapping; an error text where it is no answer; empty for null or blank.

    The stripped and the unwrapped text are bound by one-element arrays, so that each is worked out once.
    """
    say = lambda k: F.lit(FAILED + FAILURES[k])

    def unwrapped(t: Column) -> Column:
        c = F.regexp_replace(t, rf"(?iU)^({'|'.join(META_PREFIXES)})\s*", "")
        for pattern in (r"(?U)```prompt\s*|\s*```$", r"(?U)```\s*|\s*```$", "(?U)^\\s*['\"]|['\"]\\s*$"):
            c = F.regexp_replace(c, pattern, "")
        return strip(c)

    def judged(c: Column) -> Column:
        cut = shorten(c, most)
        return F.when(F.length(c) < least, say("short")).when(special_share(cut) > special, say("special")).otherwise(F.translate(cut, "\0", ""))

    def checked(t: Column) -> Column:
        failed = t.rlike("(?i)" + "|".join(rf"\Q{m}\E" for m in ERROR_MARKS))
        code = t.rlike("(?i)" + "|".join(JSON_ERROR_PATTERNS))
        return F.when(t == "", "").when(failed, say("pattern")).when(code, say("code")).otherwise(F.transform(F.array(unwrapped(t)), judged)[0])

    return F.transform(F.array(strip(F.coalesce(answer, F.lit("")))), checked)[0]


def judge_error(answer: Column) -> Column:
    """The error of a judge's answer that has no readable JSON or lacks a value, else null."""
    s = judge_scores(answer)
    absent = F.array_compact(F.array(*[F.when(s[f].isNull(), F.lit(f)) for f in [*JUDGE_FIELDS, "gesamtscore"]]))
    return F.when(answer.isNull(), "no answer").when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ", ")))


def boundaries(text: Column) -> Column:
    """Ascending offsets, from 0, of the blanks and line breaks that end a sentence; null has none.

    The text is cut before each of them, and the lengths of the pieces are added up.
    """
    pieces = F.split(F.coalesce(text, F.lit("")), BOUNDARY)
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    grown = lambda a, p: F.struct((a["n"] + F.length(p)).alias("n"), F.array_append(a["at"], a["n"] + F.length(p)).alias("at"))
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, grown, lambda a: a["at"])


def ends_whole(text: Column, limit: Column | int) -> Column:
    """Whether a summary is non-empty, within the token limit and ends like a sentence."""
    return (strip(text) != "") & (tokens_estimate(text) <= limit) & text.rlike("(?U)[.!?\"']\\s*\\z")


def eval_type(file: Column) -> Column:
    """hier or full, by the name of a file of summaries."""
    return F.when(file.contains("hier"), "hier").otherwise("full")


def model_name(column: Column) -> Column:
    """The name of an output column without its ending."""
    return F.regexp_replace(column, f"({'|'.join(OUTPUT_ENDINGS)})$", "")


def checkpoint_number(path: Column) -> Column:
    return F.regexp_extract(path, r"_(\d+)\.\w+$", 1).try_cast("long")
