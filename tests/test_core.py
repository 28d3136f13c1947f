"""Operators of the core library on small fixtures."""

from __future__ import annotations

import datetime
import difflib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions import adapters, chunking, metrics, text
from tarnwell.operators import annotation, cleaning, evaluation, ranking, relations, rolling
from tarnwell.plans import catalogue
from tarnwell.sources import tables
from tarnwell.streaming import flows

COLUMNS = cleaning.REQUIRED


def canonical(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def row(i, summary="Summary", judgement="Judgement", prompt="Prompt", subset="s"):
    return (str(i), "2022-01-01", summary, judgement, subset, "train", "0", "criteria", prompt)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


# ---- validation and cleaning


def test_validate(spark):
    assert cleaning.validate(canonical(spark, [row(1), row(2)])) == (True, [])
    ok, errors = cleaning.validate(canonical(spark, [row(1, summary=None), row(2, judgement=""), row(3, subset=None)]))
    assert not ok and "Missing values in summary: 1" in errors and "Missing values in judgement: 1" in errors
    ok, errors = cleaning.validate(canonical(spark, [row(1), row(1), row(3)]))
    assert not ok and errors == ["Duplicate ids: ['1']"]
    ok, errors = cleaning.validate(canonical(spark, [row(1)]).drop("date", "summary"))
    assert not ok and errors == ["Missing columns: date, summary"]
    ok, errors = cleaning.validate(canonical(spark, [row(1, prompt="x API-Fehler y"), row(2, judgement="a\0b")]))
    assert not ok and len(errors) == 2


def test_clean(spark):
    numbered = lambda rows: canonical(spark, rows).withColumn("_row_id", F.monotonically_increasing_id())
    out = cleaning.clean(numbered([row(1, "first"), row(1, "second"), row(3)]), "id", "_row_id", cleaning.KEPT, "synthetic_prompt").collect()
    assert sorted((r.id, r.summary) for r in out) == [("1", "first"), ("3", "Summary")]
    rows = [row(1, summary=None), row(2, judgement=""), row(3, subset=None), row(4, prompt=None), row(5, prompt="API-Fehler"), (None, *row(6)[1:])]
    assert sorted(r.id for r in cleaning.clean(numbered(rows), "id", "_row_id", cleaning.KEPT, "synthetic_prompt").collect()) == ["3", "4"]


def test_lines_after_a_hit_go(spark):
    lines = ["a", "API-Fehler 1", "b", "c", "API-Fehler 2", "API-Fehler 3", "d", "API-Fehler 4", "API-Fehler 5", "API-Fehler 6", "e"]
    kept, skip = [], False
    for x in lines:  # as a reader from top to bottom does it
        if skip:
            skip = False
        elif "API-Fehler" in x:
            skip = True
        else:
            kept.append(x)
    df = spark.createDataFrame(list(enumerate(lines)), "number long, line string")
    got = [r.line for r in cleaning.drop_after_hit(df, "number", "line", text.ERROR_PHRASES).orderBy("number").collect()]
    assert got == kept


def test_row_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = cleaning.row_ids(df, ["v"]).collect()
    assert all(r.v == r._row_id for r in got) and len(got) == 1000


def test_row_ids_of_more_rows_than_a_sample_of_ranges_sees(spark, tmp_path):
    spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("other")).write.parquet(f"{tmp_path}/t")
    got = cleaning.row_ids(spark.read.parquet(f"{tmp_path}/t"), ["v"])
    row = got.agg(F.count("*").alias("n"), F.sum((F.col("v") == F.col("_row_id")).cast("long")).alias("right"), F.count_distinct("other").alias("others")).first()
    assert (row.n, row.right, row.others) == (200_000, 200_000, 200_000)


RULES = [
    (None, "2020-01-01", False, None),
    ("Terminvorschau für Mai", "2020-01-01", True, "Headline: terminvorschau"),
    ("x" * 495 + " Terminvorschau", "2020-01-01", False, None),
    ("Die Einladung folgt.", "2020-01-01", False, None),
    ("Einladung am 15.05.2023", "2023-05-01", True, "Keyword: einladung | Datum: am 15.05.2023 (+14 Tage) | Datum: am 15.05. (+14 Tage)"),
    ("Einladung am 15.05.2019", "2020-01-01", True, "Keyword: einladung | Datum: am 15.05. (+135 Tage)"),
    ("Einladung am 31.02.2023", "2023-01-01", False, None),
    ("Einladung am 15.05.", "2023-05-14", True, "Keyword: einladung | Datum: am 15.05. (+1 Tage)"),
    ("Einladung am 15.05.2023", "no date", False, None),
    ("Einladung am 15.05.2023", None, False, None),
    ("Einladungsübersicht am 15.05.2023", "2023-05-01", False, None),
    ("Der Termin findet statt, demnächst mehr", "2020-01-01", True, "Keyword: findet statt | Zeitraum: demnächst"),
]


def test_announcement_rule(spark):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(RULES)], "i int, summary string, date string")
    got = {r.i: (r.r.flag, r.r.criteria) for r in df.select("i", cleaning.announcement(F.col("summary"), F.col("date")).alias("r")).collect()}
    for i, (_, _, flag, criteria) in enumerate(RULES):
        assert got[i] == (flag, criteria), RULES[i]


SANITIZED = [
    (None, ""), ("    ", ""), ("xx API-Fehler yy", "Fehlermuster erkannt"), ("An error: here", "Fehlermuster erkannt"), ('{"error": "x y z"}', "API-Fehlercode erkannt"),
    ('so "status": 503 it is', "API-Fehlercode erkannt"), ("Here is the prompt: Write it well please", "Write it well please"), ("```prompt\nWrite it well please\n```", "Write it well please"),
    ('"Write it well please"', "Write it well please"), ("123456789", "Antwort zu kurz"), ("1234567890", "1234567890"), ("a" * 5000, "a" * 5000), ("a" * 5001, "a" * 5000 + "..."),
    ("abcdefg###", "abcdefg###"), ("abcdef####", "Ungewöhnlich hoher Anteil an Sonderzeichen"), ("good text\0 here", "good text here"),
]


def test_sanitize(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SANITIZED)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", text.sanitize(F.col("t")).alias("s")).collect()}
    for i, (given, want) in enumerate(SANITIZED):
        assert got[i] == (text.FAILED + want if want in text.FAILURES.values() else want), given


# ---- texts


@pytest.mark.parametrize("a,b,p,r,f", [(["B", "D"], ["B", "D"], 1, 1, 1), (["B", "D"], ["B", "P"], 0.5, 0.5, 0.5), (["B"], [], 1, 0, 0), ([], ["B"], 0, 1, 0), ([], [], 1, 1, 1)])
def test_precision_recall(spark, a, b, p, r, f):
    got = one(spark, text.precision_recall(F.col("a"), F.col("b")), a=a, b=b)
    assert tuple(got) == (p, r, f)


def test_words_and_tokens(spark):
    t = "Über 12 Ärzte_x sagten: Größe, Berlin und Öl-Preis! Paris B2 Ab"
    assert one(spark, text.words(F.col("t")), t=t) == ["über", "ärzte_x", "sagten", "größe", "berlin", "und", "öl", "preis", "paris", "b", "ab"]
    assert one(spark, text.capitalised(F.col("t")), t=t) == ["Berlin", "Preis", "Paris", "Ab"]


def test_tokens_are_those_of_the_plain_patterns_for_all_characters(spark):
    """Each code point within, before and behind words."""
    points = spark.range(0x110000).where("id not between 55296 and 57343 and (id < 12800 or id % 5 = 0)")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    t = F.concat(F.lit("A"), c, F.lit("b1x "), c, F.lit("Ab Ab"), c, F.lit(" AB"), c, F.lit("B"))
    white = r"(?U)\s+"
    pieces = lambda x: F.filter(F.split(x, white), lambda w: w != "")
    plain = {
        "words": (text.words(F.col("t")), pieces(F.regexp_replace(F.lower("t"), r"(?U)[^\p{L}\p{N}_\s]|\p{Nd}", " "))),
        "bleu": (metrics.bleu_tokens(F.col("t")), F.regexp_extract_all(F.lower("t"), F.lit(r"((?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))),
        "capitalised": (text.capitalised(F.col("t")), F.array_distinct(F.filter(F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike("^[A-Z][a-zA-Z]*$")))),
        "pieces": (text.piece_count(F.col("t")), F.size(pieces(F.col("t")))),
    }
    rows = points.select(t.alias("t")).repartition(8)
    found = rows.select(*[x.alias(f"{k}_{i}") for k, two in plain.items() for i, x in enumerate(two)])
    assert found.agg(*[F.count(F.when(~F.col(f"{k}_0").eqNullSafe(F.col(f"{k}_1")), 1)).alias(k) for k in plain]).first().asDict() == dict.fromkeys(plain, 0)


def test_keyword_overlap_breaks_ties_by_place(spark):
    df = spark.createDataFrame([(1, "b a der a c b", "b x"), (2, "", "a"), (3, "der die", "der")], "id int, r string, g string")
    got = {x.id: x.v for x in df.select("id", metrics.keyword_overlap(F.col("r"), F.col("g"), 1).alias("v")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}
    assert df.limit(0).select(metrics.keyword_overlap(F.col("r"), F.col("g")).alias("v")).collect() == []


def test_generated_part(spark):
    part = lambda full, given: one(spark, text.generated_part(F.col("f"), F.col("g")), f=full, g=given)
    assert part("prompt text ", "prompt ") == "text"
    assert part("x Gerichtsurteil: a\n\nb Gerichtsurteil: c\n\n out", "zzz") == "out"
    assert part("Gerichtsurteil: no blank line", "zzz") == "Gerichtsurteil: no blank line"
    assert part(" plain ", "zzz") == "plain"


def test_claims_questions_judge(spark):
    t = "Das ist ein langer Satz hier. Kurz. Dr. Abc geht heute wieder nach Hause! Was soll das denn nun sein? Ja."
    assert one(spark, text.claims(F.col("t")), t=t) == ["Das ist ein langer Satz hier.", "Dr. Abc geht heute wieder nach Hause!", "Was soll das denn nun sein?"]
    assert one(spark, text.questions(F.col("t")), t="Was ist das?\nJa?\nkein Frage\nWer war es wohl?") == ["Was ist das?", "Wer war es wohl?"]
    fields = ", ".join(f'"{f}": {{"wert": {v}, "begründung": "x"}}' for f, v in zip(text.JUDGE_FIELDS, (8, 7, 9, 8, 8)))
    assert tuple(one(spark, text.judge_scores(F.col("t")), t=f"Hier:\n{{{fields}, \"gesamtscore\": 8.0}}\nEnde")) == (8, 7, 9, 8, 8, 8.0)
    assert set(one(spark, text.judge_scores(F.col("t")), t="no json")) == {None}


def test_annotation_flags(spark):
    assert one(spark, text.annotation_flag("publishable", F.col("t")), t="Not publishable") is True
    assert one(spark, text.annotation_flag("hallucination", F.col("t")), t="Facts outside of case") is True
    assert one(spark, text.annotation_flag("incoherent", F.col("t")), t=None) is False


def packed(t, size):
    """The chunker in plain Python."""
    import re

    if len(t) // 4 <= size:
        return [t]
    out, open_, held = [], "", 0
    for p in filter(None, map(str.strip, re.split(r"\n\s*\n+", t))):
        units = [(s, " ") for s in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", p)))] if len(p) // 4 > size else [(p, "\n\n")]
        for u, sep in units:
            if open_ and held + len(u) // 4 > size:
                out.append(open_)
                open_, held = u, len(u) // 4
            else:
                open_, held = open_ + sep + u if open_ else u, held + len(u) // 4
    return out + [open_] if open_ else out


def test_chunks(spark):
    rng = random.Random(1)
    piece = lambda: " ".join("w" * rng.randint(1, 9) + rng.choice(["", ".", "!"]) for _ in range(rng.randint(1, 30)))
    texts = ["", "short"] + ["\n\n".join(piece() for _ in range(rng.randint(1, 8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunking.chunks(F.col("t"), 20).alias("c")).collect()}
    assert all(got[i] == packed(t, 20) for i, t in enumerate(texts))


def test_levels(spark):
    assert [chunking.levels(n) for n in (1, 2, 3, 8, 9)] == [[], [900], [585, 900], [380, 585, 900], [247, 380, 585, 900]]
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 8, 9, 100)], "n int")
    assert all(r.l == chunking.levels(r.n) for r in df.select("n", chunking.level_lengths(F.col("n")).alias("l")).collect())


# ---- metrics


def test_lcs_and_meteor():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert metrics.lcs(a, b) == table[-1, -1]
    # a pair of 20 000 words has no table: the same words twice, and every second one
    long = rng.integers(0, 3000, 20_000)
    assert metrics.lcs(long, long) == 20_000 and metrics.lcs(long, long[::2]) == 10_000
    assert metrics.meteor_score(["a", "b"], ["a", "b"]) == pytest.approx(1 - 0.5 * 0.5**3)
    assert metrics.meteor_score(["a"], ["b"]) == 0


def test_bleu(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "the cat", "dog"), (3, "a b c d", "a b")], "id int, r string, g string")
    got = {r.id: r for r in df.select("id", metrics.bleu(F.col("r"), F.col("g")).alias("s")).select("id", "s.*").collect()}
    assert got[1].bleu4 == pytest.approx(1) and got[2].bleu1 == 0
    assert got[3].bleu1 == pytest.approx(math.exp(1 - 4 / 2)) and got[3].bleu4 == pytest.approx(math.exp(-1) * math.exp(0.25 * (0 + 0 + 2 * math.log(0.1))))


def test_welch(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(30)] + [("b", rng.gauss(0.7, 3)) for _ in range(12)]
    found = {(r.model_a, r.model_b): r for r in metrics.welch(spark.createDataFrame(rows, "m string, v double"), "m", "v").collect()}
    x, y = ([v for k, v in rows if k == m] for m in "ab")
    sx, sy = np.var(x, ddof=1) / len(x), np.var(y, ddof=1) / len(y)
    assert found["a", "b"].t == pytest.approx((np.mean(x) - np.mean(y)) / math.sqrt(sx + sy))
    assert found["a", "b"].df == pytest.approx((sx + sy) ** 2 / (sx**2 / 29 + sy**2 / 11))
    assert found["a", "a"].t == 0 and metrics.t_two_sided(0, 5) == pytest.approx(1)
    # fixed points of the t distribution
    assert metrics.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05) and metrics.t_two_sided(1.0, 1) == pytest.approx(0.5)


# ---- joins, ranking, evaluation


def test_coalesce_merge(spark):
    base = spark.createDataFrame([(1,), (2,), (9,)], "id int")
    a = spark.createDataFrame([(1, "a1"), (2, None)], "id int, x_summary string")
    b = spark.createDataFrame([(1, "b1"), (2, "b2")], "id int, x_summary string")
    got = relations.coalesce_merge(base, [a, spark.range(1).toDF("other"), spark.createDataFrame([(1,)], "id int"), b], "id").collect()
    assert sorted((r.id, r.x_summary) for r in got) == [(1, "a1"), (2, "b2"), (9, None)]
    twice = spark.createDataFrame([(1, 5, "z"), (1, 7, "a")], "id int, x int, y string")
    whole = {tuple(r) for r in relations.coalesce_merge(base, [twice], "id").where("id = 1").collect()}
    assert whole == {(1, 5, "z")}  # one row of the two, never a mixture


def test_evaluation_summary(spark):
    rows = [("m", 0.5, None), ("m", 1.0, None), ("m", None, None), ("m", 9.0, "bad"), ("n", float("nan"), None), ("n", 1.0, None), ("o", None, "bad")]
    got = {r.model: r for r in evaluation.summary(spark.createDataFrame(rows, "model string, v double, error string"), "model", ["v"]).collect()}
    assert (got["m"].avg_v, got["m"].total_samples, got["m"].successful_generations, got["m"].failed_generations) == (0.75, 4, 3, 1)
    assert math.isnan(got["n"].avg_v) and got["o"].avg_v is None and got["o"].success_rate == 0
    assert got["o"].error == evaluation.NO_VALID and got["m"].error is None


def test_generation_resumes_and_keeps_failures(spark):
    rows = spark.createDataFrame([(1, "ruling one", "p"), (2, "ruling two", "p"), (3, None, None)], "id long, ruling string, prompt string")
    done = spark.createDataFrame([(1, "echo")], "id long, model string")
    out = adapters.generate(relations.open_work(rows, ["echo"], done, "id"), adapters.ModelConfig("echo"), "id", "ruling", "prompt").collect()
    assert sorted(r.id for r in out) == [2, 3] and all(r.error is None for r in out)
    waits = []
    calls = iter([ValueError, ValueError, "fine"])

    def call():
        x = next(calls)
        if isinstance(x, type):
            raise x
        return x

    assert adapters.retried(call, sleep=waits.append) == "fine" and waits == [1.0, 1.5]
    assert [c.name for c in adapters.configs([{"name": "a"}, {"name": "b"}], "b")] == ["b"]


def test_annotations(spark):
    flags = lambda h: {f"pr{i}": (h, "fine", "not publishable") for i in (1, 2)}
    schema = "case_id string, id long, updated_at string, _row_id long, rank array<string>, flags map<string,struct<hallucination:string,incoherent:string,publishable:string>>"
    rows = [
        ("c1", 1, "2024-01-01T00:00:00Z", 0, ["pr1", "pr2"], flags("ok")), ("c1", 2, "2024-01-02T00:00:00Z", 1, ["pr2", "pr1"], flags("hallucination")), ("c1", 3, "2024-01-02T00:00:00Z", 2, ["pr1", "pr2"], flags("ok")),
        ("", 7, "2024-01-01T00:00:00Z", 3, ["pr1"], flags("ok")), ("c3", 8, "2024-01-01T00:00:00Z", 4, ["pr1", "pr2"], flags("")),
    ]
    mapping = spark.createDataFrame([("c1", "pr1", "m1")], "case_id string, press_id string, model_name string")
    good, bad = annotation.process(spark.createDataFrame(rows, schema), mapping, 2)
    assert sorted((r.press_id, r.model_name, r["rank"], r.hallucination, r.publishable) for r in good.collect()) == [("pr1", "m1", 2, True, True), ("pr2", "UNKNOWN", 1, True, True)]
    assert {r.case_id: r.problem for r in bad.collect()} == {"7": "wrong number of ranks", "c3": "empty quality field"}
    assert {r.model: r.avg_rank for r in annotation.model_metrics(good).collect()} == {"m1": 2.0, "UNKNOWN": 1.0}


def test_stratified(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 5, "small").when(F.col("id") < 90, "big").alias("s"))
    got = Counter(r.s for r in ranking.stratified(df, "s", "id", 10).collect())
    assert got == {"small": 5, "big": 10}


def test_usage_and_waits(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s // 60 * 0) + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([(at(s), n, "g") for s, n in ((0, 10.0), (30, 10.0), (60, 10.0), (61, 10.0))], "ts timestamp, n double, g string")
    assert [r.requests for r in rolling.usage(df, "ts", {"tokens": "n"}).orderBy("ts").collect()] == [1, 2, 3, 3]
    assert [r.wait_seconds for r in rolling.waits(df, "ts", "n", 25, "g").orderBy("ts").collect()] == [0, 0, 0.0, 29.0]


def test_waits_are_those_of_a_queue(spark):
    rng = random.Random(5)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(900)), rng.choice([0.0, 1.0, 2.5, 7.0, None]), rng.choice("ab")) for i in range(300)]
    want = {}
    for i, at, _, g in rows:
        own = sorted((x[1], x[2] or 0.0) for x in rows if x[3] == g and at - datetime.timedelta(seconds=60) <= x[1] <= at)
        over, held, wait = sum(n for _, n in own) - 20.0, 0.0, 0.0
        for when, n in own if over > 0 else ():
            held += n
            if held >= over:
                wait = max(0.0, (when - at).total_seconds() + 60)
                break
        want[i] = wait
    df = spark.createDataFrame(rows, "i int, ts timestamp, n double, g string").repartition(4)
    assert {r.i: r.wait_seconds for r in rolling.waits(df, "ts", "n", 20, "g").collect()} == want


# ---- sources and streams


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,u\n1,"a, ""q""\nline",x\n2,short\n3,long,x,y\n4,NA,\n', encoding="utf-8")
    got = sorted((r.id, r.t, r.u) for r in tables.read_tolerant(spark, str(tmp_path / "a.csv")).collect())
    assert got == [("1", 'a, "q"\nline', "x"), ("2", "short", None), ("4", None, None)]
    assert sorted(r.id for r in tables.read_tolerant(spark, str(tmp_path / "a.csv"), exact=True).collect()) == ["1", "4"]
    assert tables.header_of(spark, str(tmp_path / "a.csv")) == ["id", "t", "u"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "x",\n y'), ("2", None)], "id string, t string")
    tables.write_csv(df, str(tmp_path / "out.csv"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out.csv")).collect())) == sorted(map(tuple, df.collect()))
    tables.save_json(df, str(tmp_path / "out.json"))
    assert tables.read_table(spark, str(tmp_path / "out.json"), 1).count() == 1
    tables.write_by(df.withColumn("split", F.lit("train")), str(tmp_path / "by"), "split", "json")
    assert spark.read.json(str(tmp_path / "by")).count() == 2
    with pytest.raises(ValueError, match="Unsupported"):
        tables.read_table(spark, "x.xlsx")


def test_names_of_read_files_and_the_latest_of_them(spark, tmp_path):
    for name in ("run_5.csv/part-0.csv", "run_10.csv/part-1.csv", "run_10.csv/part-2.csv", "run_010.csv", "run_x.csv", "run_12/part-", "a b/run_7.csv"):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(f"v,id\nx,{name}\n")
    read = tables.read_glob(spark, str(tmp_path), "*")
    found = {(r.id, r.file) for r in read.collect()}
    assert found == {(n, re.search(r"([^/]+)(?:/part-[^/]+)?$", n)[1]) for n in ("run_5.csv/part-0.csv", "run_10.csv/part-1.csv", "run_10.csv/part-2.csv", "run_010.csv", "run_x.csv", "run_12/part-", "a b/run_7.csv")}
    # no row's path is searched by a pattern
    assert "regexp_extract" not in read._jdf.queryExecution().optimizedPlan().toString()
    latest = tables.latest_checkpoint(read)
    assert latest.columns == ["v", "id", "file"]
    assert {r.id for r in latest.collect()} == {"run_10.csv/part-1.csv", "run_10.csv/part-2.csv", "run_010.csv"}
    assert tables.latest_checkpoint(read.where("file = 'run_x.csv'")).count() == 0


def test_checkpoint_files_are_read_once(spark):
    from tarnwell.plans import catalogue

    made = catalogue.queries()["s9_checkpoints"](spark, "/root/testdata/sf0.001")
    assert "Scan csv" not in made._jdf.queryExecution().toString()
    assert {(r.file, r.latest) for r in made.collect()} == {("run_5.csv", False), ("run_7.csv", False), ("run_10.csv", True)}


def test_checkpoints(spark, tmp_path):
    assert tables.checkpoint_names("p", 20, 5) == ["p_5.csv", "p_10.csv", "p_15.csv", "p_20.csv"]
    assert tables.checkpoint_names("p", 20, 10) == ["p_10.csv", "p_20.csv"]
    assert tables.checkpoint_names("p", 20, 5, start=10) == ["p_15.csv", "p_20.csv"]
    assert tables.checkpoint_names("p", 18, 5, 3) == ["p_15.csv", "p_18.csv"]
    for n in (5, 10):
        (tmp_path / f"p_{n}.csv").write_text(f"id,v\n{n},x\n")
    assert [r.id for r in tables.latest_checkpoint(tables.read_glob(spark, str(tmp_path))).collect()] == ["10"]
    parts, failed = tables.read_parts(spark, [("bgh", "train", str(tmp_path / "p_5.csv")), ("bsg", "test", str(tmp_path / "none.csv"))])
    assert [(r.subset_name, r.split_name) for r in parts.collect()] == [("Bgh", "train")] and len(failed) == 1


def test_summaries_long(spark, tmp_path):
    (tmp_path / "evaluation_summary_hier.json").write_text('{"m": {"avg_bleu1": 0.5, "total_samples": 3}}')
    (tmp_path / "evaluation_summary_full.json").write_text('{"m": {"avg_bleu1": 0.25}}')
    got = sorted((r.model, r.eval_type, r.metric, r.value) for r in tables.summaries_long(spark, str(tmp_path)).collect())
    assert got == [("m", "full", "bleu1", 0.25), ("m", "hier", "bleu1", 0.5), ("m", "hier", "total_samples", 3.0)]


def test_streamed_files(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    step = lambda df: df.withColumn("tokens", text.tokens_estimate(F.col("t")))
    for k in range(2):
        spark.createDataFrame([(k, "x" * 40)], "id int, t string").write.mode("append").parquet(folder)
        flows.process_files(spark, folder, "id int, t string", step, out, mark).awaitTermination(120)
    assert sorted((r.id, r.tokens) for r in spark.read.parquet(out).collect()) == [(0, 10), (1, 10)]
    events = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 0, 5), 2.0)], "ts timestamp, n double")
    assert sum(r.requests for r in flows.usage_windows(events, "ts", "n").collect()) == 6


def test_reports(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "model string, avg_rank double")
    assert evaluation.markdown_report(df).index("| 1 | a |") < evaluation.markdown_report(df).index("| 2 | b |")
    assert "<td>a</td>" in evaluation.html_report(df, df, df)


def test_near_duplicates(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgx"), (3, "zzzz")], "id int, t string")
    assert [(r.key_a, r.key_b) for r in relations.near_duplicates(df, "id", "t", 0.8).collect()] == [(1, 2)]


@pytest.mark.parametrize("ratio", [0.0, 0.5, 0.9])
def test_near_duplicates_are_all_pairs(spark, ratio):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé \U0001f600") for _ in range(rng.choice([0, 1, 2, 3, 6, 7, 20, 60, 250]))) for _ in range(70)]
    texts += [t + rng.choice(["", "x", t, t + t[:1]]) for t in texts]
    want = {(i, j): difflib.SequenceMatcher(None, texts[i], texts[j]).ratio() for i in range(len(texts)) for j in range(i + 1, len(texts))}
    df = spark.createDataFrame([*enumerate(texts), (None, "ab"), (900, None)], "id int, t string")
    got = [(r.key_a, r.key_b, r.ratio) for r in relations.near_duplicates(df, "id", "t", ratio).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items() if v > ratio)


def test_near_dup_query_takes_the_whole_benchmark(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100)) for _ in range(60)]
    texts += [t[:95] + "01234" for t in texts[:20]]
    spark.createDataFrame([*enumerate(texts)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.key_a, r.key_b) for r in catalogue.queries()["j9_near_dup"](spark, str(tmp_path)).collect()}
    whole = dict(enumerate(texts)) | {-i - 1: t[:-4] + "1234" for i, t in enumerate(texts)}
    want = {(i, j) for i in whole for j in whole if i < j and difflib.SequenceMatcher(None, whole[i], whole[j]).ratio() > 0.9}
    assert got == want and len(got) >= 80
