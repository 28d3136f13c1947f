"""Three-way merge of two branches of a table, by operational transformation.

Only DataFrame functions. A branch says of each base row what it does to it: whether it drops
the row, what its columns become, and a script over the lines of its text. A script has one
step for each base line, in order: `retain`, `delete` or `replace` (with the new line), and
what it inserts into the gap after that line (null: nothing). The steps of both branches at
one base index are a concurrent pair; `transform` resolves each pair to one step of the merged
script and counts how, and `compose` applies the merged script to the base lines. Rows that a
branch adds whole are paired by id.

A change of one branch alone, or the same change of both, is clean. Where they differ the left
branch's step, column, row or insert wins and one conflict counts: edit-edit, edit-delete or
insert-insert. A gap stays when its line goes. A row that one branch drops counts alone: an
edit-delete conflict if the other branch changed anything of it (the left branch's state wins,
so its edits or its drop), else clean.

Base rows are worked on within themselves, however many there are of one key or how long their
texts; only rows that are added are shuffled, by id, after partial aggregation. Null columns
and texts are empty ones. Repeated base rows are merged each by itself; of several rows that
one branch adds with one id the smallest by value counts. An added row whose id the base has
too is a row beside it. Null ids are ids like any others. Columns not named are left out, so
none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"]
#: A step of a script.
STEP = "struct<kind:string,line:string,insert:string>"


def step(kind: str, line: Column | None = None, insert: Column | None = None) -> Column:
    """A step: retain, delete or replace; line: what replaces; insert: what comes into the gap after it."""
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (none if line is None else line).alias("line"), (none if insert is None else insert).alias("insert"))


def lines_of(text: Column) -> Column:
    """The lines of a text; an empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _one(condition: Column) -> Column:
    return condition.cast("long")


def transform(left: Column, right: Column) -> Column:
    """The merged script of two concurrent ones, each step with its counts, as an array of structs."""

    def pair(x: Column, y: Column) -> Column:
        kept_x, kept_y = x["kind"] == "retain", y["kind"] == "retain"
        both = ~kept_x & ~kept_y
        same = (x["kind"] == y["kind"]) & x["line"].eqNullSafe(y["line"])
        gone = (x["kind"] == "delete") | (y["kind"] == "delete")
        put_x, put_y = x["insert"].isNotNull(), y["insert"].isNotNull()
        clash = put_x & put_y & (x["insert"] != y["insert"])
        return F.struct(
            F.when(kept_x, y["kind"]).otherwise(x["kind"]).alias("kind"),
            F.when(kept_x, y["line"]).otherwise(x["line"]).alias("line"),
            F.coalesce(x["insert"], y["insert"]).alias("insert"),
            (_one((~kept_x | ~kept_y) & (~both | same)) + _one((put_x | put_y) & ~clash)).alias("n_clean"),
            _one(both & ~same & ~gone).alias("n_edit_edit"),
            _one(both & ~same & gone).alias("n_edit_delete"),
            _one(clash).alias("n_insert_insert"),
        )

    return F.zip_with(left, right, pair)


def compose(lines: Column, script: Column) -> Column:
    """The lines that a script makes of the base lines."""

    def made(line: Column, s: Column) -> Column:
        own = F.when(s["kind"] == "retain", F.array(line)).when(s["kind"] == "replace", F.array(s["line"])).otherwise(F.array().cast("array<string>"))
        return F.when(s["insert"].isNull(), own).otherwise(F.concat(own, F.array(s["insert"])))

    return F.flatten(F.zip_with(lines, script, made))


def idle(script: Column) -> Column:
    """Whether a script changes nothing."""
    return ~F.exists(script, lambda s: (s["kind"] != "retain") | s["insert"].isNotNull())


def merge_rows(rows: DataFrame, key: str, columns: list[str], text: str, left: str = "left", right: str = "right") -> DataFrame:
    """key, columns, text (all null if the row is gone), present and COUNTS of each base row.

    rows: the base, with a struct (drop: boolean, a value for each column, script: an array of
    steps, one a line) for each branch, in the columns named left and right.
    """
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    base = rows.select(F.col(key), *[value(F.col(c)).alias(c) for c in columns], lines_of(F.col(text)).alias("_lines"), F.col(left).alias("_l"), F.col(right).alias("_r"))
    l, r = F.col("_l"), F.col("_r")  # noqa: E741
    moved = lambda side: [value(side[c]) != F.col(c) for c in columns]
    base = base.withColumn("_ops", transform(l["script"], r["script"]))
    touched = lambda side: F.exists(F.array(*moved(side), ~idle(side["script"])), lambda x: x)
    base = base.withColumn("_case", F.when(l["drop"] & r["drop"], "both").when(l["drop"], F.when(touched(r), "left conflict").otherwise("left")).when(r["drop"], F.when(touched(l), "right conflict").otherwise("right")).otherwise("kept"))
    kept, lost = F.col("_case") == "kept", F.col("_case") == "right conflict"
    # of a row that only the right branch drops against edits, the left branch's state stays
    script = F.when(kept, F.transform("_ops", lambda s: F.struct(s["kind"].alias("kind"), s["line"].alias("line"), s["insert"].alias("insert")))).when(lost, l["script"].cast(f"array<{STEP}>"))
    out = {c: F.when(kept, F.when(a, value(l[c])).otherwise(value(r[c]))).when(lost, value(l[c])) for c, a in zip(columns, moved(l))}
    pairs = list(zip(columns, moved(l), moved(r)))
    clash = [a & b & (value(l[c]) != value(r[c])) for c, a, b in pairs]
    per_column = {"n_clean": [_one((a | b) & ~x) for (_, a, b), x in zip(pairs, clash)], "n_edit_edit": [_one(x) for x in clash]}
    alone = {"n_clean": _one(F.col("_case").isin("both", "left", "right")), "n_edit_delete": _one(F.col("_case").endswith("conflict"))}

    def count(name: str) -> Column:
        total = F.aggregate("_ops", F.lit(0).cast("long"), lambda n, s: n + s[name])
        for more in per_column.get(name, []):
            total = total + more
        return F.when(kept, total).otherwise(alone.get(name, F.lit(0).cast("long"))).alias(name)

    return base.select(key, *[v.alias(c) for c, v in out.items()], F.array_join(compose(F.col("_lines"), script), "\n").alias(text), (kept | lost).alias("present"), *[count(c) for c in COUNTS])


def merge_added(left: DataFrame, right: DataFrame, key: str, columns: list[str], text: str) -> DataFrame:
    """As merge_rows, of the rows that the branches add whole: tables of key, columns and text."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    whole = F.struct(*map(value, [*columns, text]))
    sides = left.select(F.col(key), whole.alias("l"), F.lit(None).alias("r")).unionByName(right.select(F.col(key), F.lit(None).alias("l"), whole.alias("r")))
    both = sides.groupBy(key).agg(F.min("l").alias("l"), F.min("r").alias("r"))
    clash = F.coalesce(F.col("l") != F.col("r"), F.lit(False))
    counts = {"n_clean": _one(~clash), "n_insert_insert": _one(clash)}
    made = F.coalesce("l", "r")
    return both.select(key, *[made[c].alias(c) for c in [*columns, text]], F.lit(True).alias("present"), *[counts.get(c, F.lit(0).cast("long")).alias(c) for c in COUNTS])


def merge(rows: DataFrame, added_left: DataFrame, added_right: DataFrame, key: str = "doc_id", columns: list[str] | tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """The merged table with its counts: a row for each base row, gone ones included, and for each id that is added."""
    return merge_rows(rows, key, list(columns), text).unionByName(merge_added(added_left, added_right, key, list(columns), text))


# ---- branches by codes

#: Codes of a digest: what they mean for a column or line, for the gap after a line, and for a row.
MODULUS, GONE, MARKS, AFTER = 17, 0, {1: "!", 2: "?"}, {3: "!", 4: "?"}
#: Ids of rows that a branch adds: this less the base id.
ADDED = {"L": -1, "R": -5}


def code(branch: str, id_column: str, name: Column) -> Column:
    """crc32 of branch:id:name modulo MODULUS; a null id is an empty one."""
    return F.crc32(F.concat(F.lit(f"{branch}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), name).cast("binary")) % MODULUS


def coded_branch(branch: str, docs: DataFrame, key: str, columns: list[str], text: str) -> Column:
    """A branch of merge_rows whose changes follow from the codes of row, columns and lines."""

    def column(c: str) -> Column:
        value, k = F.coalesce(F.col(c).cast("string"), F.lit("")), code(branch, key, F.lit(c))
        out = F.when(k == GONE, "")
        for n, mark in MARKS.items():
            out = out.when(k == n, F.concat(value, F.lit(mark)))
        return out.otherwise(value).alias(c)

    def line(value: Column, i: Column) -> Column:
        # the code is bound by a list of one, so that it is worked out once
        def made(k: Column) -> Column:
            out = F.when(k == GONE, step("delete"))
            for n, mark in MARKS.items():
                out = out.when(k == n, step("replace", F.concat(value, F.lit(mark))))
            for n, mark in AFTER.items():
                out = out.when(k == n, step("retain", None, F.lit(mark)))
            return out.otherwise(step("retain"))

        return F.transform(F.array(code(branch, key, i.cast("string"))), made)[0]

    return F.struct((code(branch, key, F.lit("row")) == GONE).alias("drop"), *map(column, columns), F.transform(lines_of(F.col(text)), line).alias("script"))


def coded_added(branch: str, docs: DataFrame, key: str, columns: list[str], text: str) -> DataFrame:
    """The rows that a branch adds by the codes of the base rows: their mark as text, all else as in the base."""
    k = F.col("_code")
    mark = None
    for n, m in AFTER.items():
        mark = F.when(k == n, m) if mark is None else mark.when(k == n, m)
    rows = docs.select((F.lit(ADDED[branch]) - F.col(key)).alias(key), *columns, code(branch, key, F.lit("row")).alias("_code"))
    return rows.where(k.isin(*AFTER)).select(key, *columns, mark.alias(text))


def merge_coded(docs: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """The merge of the branches L and R that the codes of the base make."""
    names = list(columns)
    rows = docs.select(key, *names, text, *[coded_branch(b, docs, key, names, text).alias(side) for b, side in (("L", "left"), ("R", "right"))])
    return merge(rows, *[coded_added(b, docs, key, names, text) for b in ("L", "R")], key, names, text)


def digest(merged: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """The merged rows with a digest in place of the text; of rows that are gone, nulls."""
    present = lambda c: F.when(F.col("present"), c)
    return merged.select(key, *[present(F.col(c)).alias(c) for c in columns], present(F.sha2(F.col(text).cast("binary"), 256)).alias("text_sha256"), *COUNTS)
