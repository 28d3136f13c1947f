"""URL filter: host and path rules, and a character language-model ratio for all other URLs.

Only DataFrame functions. The URLs that a rule settles teach two character models, one of
accepted and one of rejected URLs. Each predicts a character from the three before it,
interpolating all orders down to a uniform one by the number of different characters seen
after a context (Witten-Bell), so that the order used varies with what is known. A URL's
score is the mean over its characters of the difference of the two log-likelihoods. A
quarter of the settled URLs, by a digest, teaches no model: the threshold is calibrated on
them, midway between the mean scores of accepted and rejected ones (a class that has none
among them is represented by all its settled URLs). Each different URL (host and path)
teaches once, so a hot one has no more say than others.

Null URLs and those without `://` have empty host and path and are judged by the model
like any other. If no URL is accepted or none rejected by rules, all others are allowed.
Repeated rows and ids give repeated results, null ids stay, other columns are passed by.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Workspace

#: host, path, verdict
Rule = tuple[str, str, str]
ORDER = 4
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rows up to which the gram table is broadcast (some 40 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
#: First hexadecimal digits of the digests of URLs that calibrate.
CALIBRATION = "0123"
_START, _END = "\u0002", "\u0003"


def split_url(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, PARTS, 1), ascii_uppercase, ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def match(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def held_out(url: Column) -> Column:
    """Whether a URL serves the calibration: one in four, by the first digit of its MD5."""
    return F.substring(F.md5(url), 1, 1).isin(*CALIBRATION)


def grams(texts: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of u with the ORDER - 1 before it."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), F.col("u"), F.lit(_END))
    pieces = F.transform(F.sequence(F.lit(1), F.length("u") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
    return texts.select(*keep, F.explode(pieces).alias("gram"))


def gram_table(counts: DataFrame) -> DataFrame:
    """gram, llr: log-likelihood of a gram's last character under the accepted model less that under the rejected one.

    counts: gram, allow, block - occurrences in accepted and rejected URLs, zero included.
    """
    sides = ("allow", "block")
    table = counts.select("gram", *sides)
    base = None  # probabilities one order below, by the gram of that order
    for k in range(1, ORDER + 1):
        level = table.groupBy(F.expr(f"right(gram, {k})").alias(f"g{k}")).agg(*[F.sum(s).alias(s) for s in sides])
        context = F.expr(f"left(g{k}, {k - 1})").alias("context")
        totals = level.groupBy(context).agg(*[F.sum(s).alias(f"{s}_n") for s in sides], *[F.sum((F.col(s) > 0).cast("long")).alias(f"{s}_t") for s in sides])
        level = level.withColumn("context", F.expr(f"left(g{k}, {k - 1})")).join(totals, "context")
        if base is None:
            level = level.withColumns({f"{s}_p0": F.lit(1 / 256) for s in sides})
        else:
            level = level.withColumn("below", F.expr(f"right(g{k}, {k - 1})")).join(base, "below")
        mixed = {
            s: F.when(F.col(f"{s}_n") == 0, F.col(f"{s}_p0")).otherwise((F.col(s) + F.col(f"{s}_t") * F.col(f"{s}_p0")) / (F.col(f"{s}_n") + F.col(f"{s}_t")))
            for s in sides
        }
        level = level.select(f"g{k}", *[mixed[s].alias(f"{s}_p0") for s in sides])
        base = level.withColumnRenamed(f"g{k}", "below")
    return base.select(F.col("below").alias("gram"), (F.log("allow_p0") - F.log("block_p0")).alias("llr"))


def judge(pages: DataFrame, rules: list[Rule], id_column: str = "page_id") -> DataFrame:
    """The id, host, path, rule, verdict and llr (null where a rule decides) of each row."""
    work = Workspace(pages.sparkSession)
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("m", match(F.col("host"), F.col("path"), rules)).withColumn("u", F.concat("host", "path"))
    known = F.col("m.verdict")
    urls = rows.groupBy("u").agg(F.max(known).alias("v")).withColumn("calibrates", held_out(F.col("u")))
    urls = work.table(urls, "urls")
    sums = [F.sum((F.coalesce(F.col("v") == s, F.lit(False)) & ~F.col("calibrates")).cast("long")).alias(s) for s in ("allow", "block")]
    # written once: each order of the models reads the counts twice
    counts = work.table(grams(urls, "v", "calibrates").groupBy("gram").agg(*sums), "counts")
    table = work.table(gram_table(counts), "grams")
    model = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    scored = grams(urls, "u", "v", "calibrates").join(model, "gram").groupBy("u").agg(F.avg("llr").alias("llr"), F.max("v").alias("v"), F.max("calibrates").alias("calibrates"))
    scored = work.table(scored, "scores")
    side = lambda s: F.coalesce(F.avg(F.when((F.col("v") == s) & F.col("calibrates"), F.col("llr"))), F.avg(F.when(F.col("v") == s, F.col("llr")))).alias(s)
    means = scored.agg(side("allow"), side("block")).first()
    settled = means["allow"] is not None and means["block"] is not None
    threshold = (means["allow"] + means["block"]) / 2 if settled else 0.0
    by_model = F.when((F.col("llr") >= threshold) | F.lit(not settled), "allow").otherwise("block")
    return rows.join(scored.select("u", "llr"), "u").select(
        id_column, "host", "path", F.col("m.rule").alias("rule"), F.coalesce(known, by_model).alias("verdict"), F.when(known.isNull(), F.col("llr")).alias("llr")
    )
