"""Metrics, evaluation runs, hierarchical summaries, readers and sinks against plain Python."""

from __future__ import annotations

import json
import math
import os
import random
import struct
import uuid
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tarnwell.functions import adapters, metrics, text
from tarnwell.functions.stemming import porter
from tarnwell.operators import annotation, evaluation, hierarchy, prompts
from tarnwell.plans import catalogue, text_queries
from tarnwell.sources import tables

DATA = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def pairs(spark):
    return evaluation.turn_pairs(table(spark, "conversations")).collect()


def words(t):
    return regex.sub(r"[^\p{L}\p{N}_\s]|\p{Nd}", " ", t.lower()).split()


# ---- metrics


def test_porter_stems():
    want = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "triplicate": "triplic", "hopefulness": "hope",
        "electrical": "electr", "revival": "reviv", "adjustable": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    }
    assert {w: porter(w) for w in want} == want


def test_stemmed_rouge_is_that_of_plain_counting(spark, pairs):
    def tokens(t):
        return [porter(w) if len(w) > 3 else w for w in regex.sub("[^a-z0-9]+", " ", t.lower()).split()]

    def f(matched, a, b):
        p, r = matched / b if b else 0, matched / a if a else 0
        return 2 * p * r / (p + r) if p + r else 0

    for r in catalogue.queries()["t11_rouge_stemmed"](spark, DATA).collect():
        row = next(x for x in pairs if (x.conv_id, x.turn) == (r.conv_id, r.turn))
        a, b = tokens(row.reference), tokens(row.generated)
        for k, got in ((1, r.rouge1), (2, r.rouge2)):
            x, y = (Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1)) for t in (a, b))
            assert got == pytest.approx(f(sum((x & y).values()), sum(x.values()), sum(y.values())))
        line = [0] * (len(b) + 1)
        for w in a:
            last = line[:]
            for j, v in enumerate(b):
                line[j + 1] = last[j] + 1 if v == w else max(line[j], last[j + 1])
        assert r.rougeL == pytest.approx(f(line[-1], len(a), len(b)))


def test_meteor_query(spark, pairs):
    for r in catalogue.queries()["t13_meteor"](spark, DATA).collect():
        row = next(x for x in pairs if (x.conv_id, x.turn) == (r.conv_id, r.turn))
        a, b = words(row.reference), words(row.generated)
        assert r.meteor == pytest.approx(metrics.meteor_score(a, b) if a and b else 0.0)


def test_grams_of_any_order_in_one_batch(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for i in range(80)] + [(80, [], []), (81, None, ["a"])]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>").coalesce(1)
    got = {r.i: r.m for r in df.select("i", metrics.gram_matches(F.col("a"), F.col("b"), (1, 2, 3, 4)).alias("m")).collect()}
    for i, a, b in rows:
        for m in got[i]:
            x, y = (Counter(tuple((t or [])[j : j + m.k]) for j in range(len(t or []) - m.k + 1)) for t in (a, b))
            assert (m.matched, m.n_ref, m.n_gen) == (sum((x & y).values()), sum(x.values()), sum(y.values()))


def test_custom_bleu_weights(spark):
    df = spark.createDataFrame([("a b c", "a b d")], "r string, g string")
    got = df.select(metrics.bleu(F.col("r"), F.col("g"), {"_pair": (0.0, 1.0)}).alias("s")).first().s
    assert got.bleu_pair == pytest.approx(0.5)


def test_two_sided_p(spark):
    def tail(t, df):  # the density, integrated by Simpson's rule
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        x = np.linspace(0, abs(t), 20_001)
        y = c * (1 + x**2 / df) ** (-(df + 1) / 2)
        return 1 - 2 * (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    values = table(spark, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double")).toPandas()
    by = {k: v.to_numpy() for k, v in values.groupby("l_returnflag")["l_extendedprice"]}
    for r in catalogue.queries()["a22_welch_p"](spark, DATA).collect():
        x, y = by[r.model_a], by[r.model_b]
        if r.model_a == r.model_b:
            assert r.p == pytest.approx(1)
            continue
        a, b = np.var(x, ddof=1) / len(x), np.var(y, ddof=1) / len(y)
        assert r.p == pytest.approx(tail((x.mean() - y.mean()) / math.sqrt(a + b), (a + b) ** 2 / (a**2 / (len(x) - 1) + b**2 / (len(y) - 1))), abs=1e-6)


def test_samples_by_hash(spark):
    hashed = lambda parts, seed=42: seed if not parts else hashed(parts[1:], xxhash.xxh64_intdigest(parts[0], seed=seed))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    split = {r.doc_id: r.split for r in catalogue.queries()["l7_split"](spark, DATA).collect()}
    places = sorted(split, key=lambda i: signed(hashed([struct.pack("<q", i), struct.pack("<i", 42)])))
    assert [split[i] for i in places] == ["train"] * int(len(split) * 0.9) + ["validation"] * (len(split) - int(len(split) * 0.9))
    turns = {}
    for r in table(spark, "conversations").orderBy("turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {}
    for r in catalogue.queries()["w8_shuffled_tasks"](spark, DATA).collect():
        got.setdefault(r.case_id, []).append((int(r.press_id[2:]), r.model_name))
    for case, items in turns.items():
        key = lambda x, case=case: (signed(hashed([struct.pack("<q", case), x[0].encode(), struct.pack("<i", 42)])), *x)
        assert [m for _, m in sorted(got[case])] == [m for m, _ in sorted(items, key=key)]


# ---- evaluation


def test_all_metrics_of_a_run(spark, pairs):
    scored = {(r.conv_id, r.turn): r for r in evaluation.score(evaluation.turn_pairs(table(spark, "conversations")), adapters=text_queries.STAND_INS, source="reference").collect()}
    assert len(scored) == len(pairs)
    for r in scored.values():
        if r.error is None:
            assert all(r[m] is not None or m in ("qags_valid_answers", "factcc_consistency_ratio", "bertscore_f1") for m in evaluation.METRICS)
            assert r.rouge1_recall <= 1 and r.llm_judge_gesamtscore == len(r.generated) % 10 + 1
    bare = evaluation.score(evaluation.turn_pairs(table(spark, "conversations")).limit(3)).collect()
    assert all(r.bertscore_f1 is None and r.qags_score is None and r.rougeL_fmeasure is not None for r in bare)


def test_vectors_made_within_the_task_score_like_columns_of_vectors(spark):
    import dataclasses

    from tarnwell.functions.adapters import hashed_vectors

    turns = evaluation.turn_pairs(table(spark, "conversations")).unionByName(spark.createDataFrame([(-1, 0, "a b", "...", "m"), (-2, 0, None, "a b a", "m")], "conv_id long, turn int, reference string, generated string, model string"))
    within = evaluation.score(turns, adapters=text_queries.STAND_INS, source="reference")
    columns = evaluation.score(turns, adapters=dataclasses.replace(text_queries.STAND_INS, vectors=None, token_vectors=hashed_vectors), source="reference")
    assert "hashed_vectors" not in within._jdf.queryExecution().toString()
    names = [*evaluation.BERTSCORE, "semantic_similarity"]
    got, want = ({(r.conv_id, r.turn): [r[n] for n in names] for r in df.select("conv_id", "turn", *names).collect()} for df in (within, columns))
    assert got.keys() == want.keys()
    assert all(a == b if None in (a, b) else math.isclose(a, b, abs_tol=1e-9) for k in got for a, b in zip(got[k], want[k]))


def test_errors_of_factual_metrics(spark):
    rows = [(1, "alpha beta", "Kurz."), (2, "alpha beta gamma delta eins", "Alpha beta gamma delta eins. Alpha beta."), (3, "x", ""), (4, "", "zeta eta theta iota kappa lambda.")]
    got = {r.i: r for r in evaluation.score(spark.createDataFrame(rows, "i int, reference string, generated string"), source="reference", adapters=text_queries.STAND_INS).collect()}
    assert got[1].factcc_error == metrics.NO_CLAIMS and math.isnan(got[1].factcc_score) and got[1].qags_error == metrics.NO_QUESTIONS and got[1].qags_question_count == 0
    assert got[2].factcc_score == 1 and got[2].qags_score == 1 and got[2].qags_error is None and got[2].factcc_claim_count == 1
    assert got[3].error == evaluation.NO_TEXT and got[3].rouge1_recall is None and got[3].factcc_error is None
    assert got[4].qags_error == metrics.NO_ANSWERS and got[4].factcc_score == 0
    bad = evaluation.Adapters(judge=lambda s, g, r: F.lit('{"klarheit": {"wert": 3}}'))
    judged = evaluation.score(spark.createDataFrame(rows[:1], "i int, reference string, generated string"), source="reference", adapters=bad).first()
    assert judged.llm_judge_klarheit is None and "gesamtscore" in judged.llm_judge_error


def test_evaluate_resumes_and_tells_of_lost_columns(spark):
    wide = spark.createDataFrame([(i, f"text number {i}", f"text {i}", None if i == 2 else "other") for i in range(4)], "row int, press string, m1 string, m2 string")
    first, _ = evaluation.evaluate(wide.where("row < 2"), "row", "press", ["m1", "m2"])
    kept = first.withColumn("rouge1_recall", F.lit(0.25))
    scored, summed = evaluation.evaluate(wide, "row", "press", ["m1", "m2", "m3"], kept)
    assert scored.count() == 8 and scored.where("rouge1_recall = 0.25").count() == 4
    got = {r.model: r for r in summed.collect()}
    assert got["m3"].error == evaluation.NO_COLUMN.format("m3") and got["m3"].total_samples is None
    assert (got["m2"].total_samples, got["m2"].successful_generations, got["m2"].failed_generations) == (4, 3, 1)
    assert evaluation.results_table(summed.where("error is null")).columns[:4] == ["model", "entity_overlap", "keyword_overlap", "length_ratio"]


def test_metric_order():
    names = ["bleu2", "rouge1_recall", "rouge1_precision", "bertscore_f1", "new", "keyword_overlap", "rougeL_fmeasure", "llm_judge_klarheit", "rouge1_fmeasure"]
    assert evaluation.metric_order(names) == ["new", "keyword_overlap", "rouge1_precision", "rouge1_recall", "rouge1_fmeasure", "rougeL_fmeasure", "bleu2", "bertscore_f1", "llm_judge_klarheit"]


# ---- hierarchical summaries


def summarised(chunks, s):
    """All levels of a document in plain Python, as (level, place, summary)."""
    c, most = s.summarization, s.summarization.max_summary_length
    model = hierarchy.FirstSentences()
    depth, n = 0, len(chunks)
    while n > 1:
        n, depth = -(-n // max(2, (c.max_context_length - most) // s.chunking.chunk_size)), depth + 1
    lengths, x = [], most
    for _ in range(depth):
        lengths.insert(0, x)
        x = int(x * c.word_ratio)
    now, out = [model.summarize("", t, lengths[0] if lengths else most) for t in chunks], []
    out += [(0, i, t) for i, t in enumerate(now)]
    for level in range(1, depth + 1):
        if len(now) == 1:
            break
        limit = lengths[level] if level < len(lengths) else most
        room = c.max_context_length - limit - len(hierarchy.TEMPLATES["merge"].format(words="", text="")) // 4 - 50
        batches, open_, held = [], [], 0
        for t in now:
            entry = f"Summary {len(open_) + 1}:\n\n{t}"
            if open_ and held + len(entry) // 4 > room:
                batches.append(open_)
                open_, held = [entry], len(entry) // 4
            else:
                open_.append(entry)
                held += len(entry) // 4
        now = [model.summarize("", "\n\n".join(b), limit) for b in [*batches, open_]]
        out += [(level, i, t) for i, t in enumerate(now)]
    return now[0], out


def test_hierarchical_summaries(spark):
    docs = spark.createDataFrame([(i, " ".join(f"Word{k} and more of {k}." for k in range(i * 23))) for i in range(12)] + [(50, None)], "id long, judgement string")
    small = text_queries.SMALL
    chunked, _ = hierarchy.run_chunking(docs, small)
    got = {r.id: r for r in hierarchy.summarize_chunks(chunked, "id", "chunks", small).collect()}
    assert max(len(r.chunks) for r in chunked.collect()) > 6
    for r in chunked.collect():
        last, levels = summarised(r.chunks, small)
        assert got[r.id].summary == last and [tuple(x) for x in got[r.id].levels] == levels
    none = hierarchy.summarize_chunks(spark.createDataFrame([(1, [])], "id long, chunks array<string>"), "id", "chunks").first()
    assert none.summary == "" and none.levels == []
    assert hierarchy.summarize_chunks(chunked.limit(0), "id", "chunks", small).count() == 0


def counted_heads(folder, fails=""):
    """A summarizer that leaves a file for each call, and fails for texts with a word."""

    class Counted:
        def summarize(self, prompt, text, max_tokens):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            if fails and fails in text:
                raise ValueError("no summary")
            return text[: 4 * max_tokens].rstrip(". ") + "."

    return Counted


def test_summaries_by_level(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"Word{k} and more of {k}." for k in range(i * 23))) for i in range(12)] + [(50, None)], "id long, judgement string")
    small, chunked = text_queries.SMALL, hierarchy.with_chunks(docs, text_queries.SMALL)
    want = {r.id: (r.summary, [tuple(x) for x in r.levels]) for r in hierarchy.summarize_chunks(chunked, "id", "chunks", small).collect()}
    got = hierarchy.summarize_by_level(chunked, "id", "chunks", str(tmp_path / "plain"), small)
    assert {r.id: (r.summary, [tuple(x) for x in r.levels]) for r in got.collect()} == want
    assert max(x[0] for _, levels in want.values() for x in levels) > 1
    # stopped after level 1, called again: no chunk and no merge is called twice, and nothing of the run's state is left
    (tmp_path / "calls").mkdir()
    build, folder = counted_heads(str(tmp_path / "calls")), str(tmp_path / "stopped")
    assert hierarchy.summarize_by_level(chunked, "id", "chunks", folder, small, build, stop_after=1) is None
    first = len(os.listdir(tmp_path / "calls"))
    assert sorted(x for x in os.listdir(f"{folder}/frontier") if x.isdigit()) == ["0", "1"]
    made = hierarchy.summarize_by_level(chunked, "id", "chunks", folder, small, build)
    rows = made.collect()
    assert sum(len(r.levels) for r in rows) == len(os.listdir(tmp_path / "calls")) > first
    assert hierarchy.summarize_by_level(chunked, "id", "chunks", folder, small, build).count() == 13
    assert sum(len(r.levels) for r in rows) == len(os.listdir(tmp_path / "calls")) and not os.path.exists(f"{folder}/frontier")
    none = hierarchy.summarize_by_level(chunked.limit(0), "id", "chunks", str(tmp_path / "none"), small)
    assert none.count() == 0


def test_a_failed_call_keeps_its_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"Word{k} and more of {k}." for k in range(i * 60))) for i in range(1, 5)], "id long, judgement string")
    (tmp_path / "calls").mkdir()
    build = counted_heads(str(tmp_path / "calls"), "Word100 ")
    chunked = hierarchy.with_chunks(docs, text_queries.SMALL)
    rows = {r.id: r for r in hierarchy.summarize_by_level(chunked, "id", "chunks", str(tmp_path / "run"), text_queries.SMALL, build).collect()}
    assert set(rows) == {1, 2, 3, 4} and all(r.summary for r in rows.values())
    errors = {(r.id, r.level, r.error) for r in spark.read.parquet(str(tmp_path / "run/errors")).collect()}
    assert errors == {(i, 0, "no summary") for i in (2, 3, 4)}
    whole = hierarchy.summarize_chunks(chunked, "id", "chunks", text_queries.SMALL, build).collect()
    assert {r.id: r.summary for r in whole} == {i: r.summary for i, r in rows.items()}


def test_run_of_all_stages(spark):
    docs = spark.createDataFrame([(i, " ".join(f"Word{k} and more." for k in range(i * 90)), "Write") for i in range(1, 5)] + [(9, "No prompt.", None)], "id long, judgement string, synthetic_prompt string")
    got = {r.id: r.m for r in hierarchy.run(docs, "m", text_queries.SMALL).collect()}
    assert set(got) == {1, 2, 3, 4, 9} and got[9] == "" and all(got[i] for i in range(1, 5))
    wide = hierarchy.run_aggregation([hierarchy.run(docs, "m", text_queries.SMALL), hierarchy.run(docs, "k", text_queries.SMALL)], docs.select("id"))
    assert wide.columns == ["id", "m", "k"] and wide.count() == 5


def test_attempts_stop_at_a_sound_summary(spark):
    class Slow:
        def __init__(self):
            self.made = 0

        def summarize(self, prompt, given, max_tokens):
            self.made += 1
            return "no end" if self.made < 3 else f"Made {self.made}."

    df = spark.createDataFrame([("p", "t", 10)], "p string, t string, n int")
    call = lambda tries, check=True: df.select(hierarchy.attempts(Slow, tries, check)(F.col("p"), F.col("t"), F.col("n")).alias("s")).first().s
    assert call(5) == "Made 3." and call(2) == "no end" and call(5, False) == "no end"


def test_templates_are_filled_once(spark):
    df = spark.createDataFrame([("{words} and {text}",)], "t string")
    assert df.select(hierarchy.chunk_prompt(F.col("t"), F.lit(7), 0).alias("p")).first().p == "Summarize the following text in approximately 7 words:\n\n{words} and {text}"


# ---- adapters, readers, sinks


def test_lemmas_and_lengths(spark):
    def tagger(t):
        return [adapters.Token("Richter", "Richter"), adapters.Token("gehen", "Gehen", "VERB"), adapters.Token("x1y", "x1y"), adapters.Token("und", "und", "CCONJ"), adapters.Token("die", "die", stop=True), adapters.Token("ab", "ab"), adapters.Token(str(len(t)), str(len(t)))]

    df = spark.createDataFrame([(1, "a" * 6000), (2, None)], "i int, t string")
    assert {r.i: r.l for r in df.select("i", adapters.lemmas(F.col("t"), tagger, True).alias("l")).collect()} == {1: "richter gehen", 2: ""}
    assert [r.n for r in df.select(adapters.token_length(F.col("t")).alias("n")).collect()] == [1500, 0]


def test_arity_reader_and_repair(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"a ""q"", b\nline"\n2\n3,x,y\n4,"open\n', encoding="utf-8")
    assert sorted((r.id, r.t) for r in tables.read_arity(spark, str(tmp_path / "a.csv")).collect()) == [("1", 'a "q", b\nline'), ("4", "open\n")]
    assert prompts.fix_format(spark, str(tmp_path / "a.csv"), str(tmp_path / "out.csv")) == 2
    (tmp_path / "b.csv").write_text("id,synthetic_prompt\n1,fine\n2,API-Fehler\n3,\n", encoding="utf-8")
    assert sorted(r.id for r in prompts.clean_prompts(spark, str(tmp_path / "b.csv"), "synthetic_prompt").collect()) == ["1", "3"]
    (tmp_path / "c.csv").write_text("a\nAPI-Fehler\nb\nc\n", encoding="utf-8")
    assert [r.line for r in prompts.clean_prompts(spark, str(tmp_path / "c.csv"), "synthetic_prompt").collect()] == ["a", "c"]


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "m_results.json").write_text(json.dumps({"summary": {"avg_bleu1": 0.5}, "detailed_results": {"0": {"bleu1": 0.5, "prompt": "p"}, "1": {"error": "none"}}}))
    got = {(r.model, r.row_id, r.metric, r.value) for r in tables.evaluation_details(spark, str(tmp_path)).collect()}
    assert got == {("m", "0", "bleu1", "0.5"), ("m", "0", "prompt", "p"), ("m", "1", "error", "none")}


def test_cells_keep_their_white_space(spark, tmp_path):
    cells = ["  ends ", "\n\tx\n", " ", "a\r\nb ", '" q "', "\\ \\"]
    rows = spark.createDataFrame([(i, c, "s") for i, c in enumerate(cells)], "i int, t string, s string")
    tables.write_csv(rows, str(tmp_path / "all"), backslash=True)
    tables.write_by(rows, str(tmp_path / "by"), "s", "csv")
    assert {int(r.i): r.t for r in tables.read_csv(spark, str(tmp_path / "all"), na=False, backslash=True).collect()} == dict(enumerate(cells))
    assert {int(r.i): r.t for r in tables.read_arity(spark, str(tmp_path / "by" / "s=s")).collect()} == dict(enumerate(cells))


def test_run_in_steps_goes_on_where_it_stopped(spark, tmp_path):
    rows, calls = spark.range(50).toDF("row"), []

    def step(df, fail_at=None):
        calls.append(df.count())
        if len(calls) == fail_at:
            raise RuntimeError("stopped")
        return df.withColumn("t", F.lit("back\\slash"))

    with pytest.raises(RuntimeError):
        tables.run_in_steps(rows, "row", [20, 40, 50], lambda df: step(df, 2), str(tmp_path))
    made = tables.run_in_steps(rows, "row", [20, 40, 50], step, str(tmp_path))
    assert calls == [20, 20, 20, 10] and sorted(int(r.row) for r in made.collect()) == list(range(50)) and made.first().t == "back\\slash"


def test_sample_needs_its_columns(spark):
    with pytest.raises(ValueError, match="Missing required columns: summary"):
        annotation.prepare(spark.createDataFrame([(1, "s", "p", "j")], "id long, subset_name string, synthetic_prompt string, judgement string"), 2)
    base = spark.createDataFrame([(1,), (2,)], "id long")
    out, lacking, counts = annotation.augment(base, [("m", "full", spark.createDataFrame([(1, "a"), (7, "z")], "id long, m string")), ("none", "full", None)])
    assert {r.id: [x.model_name for x in r.model_summaries] for r in out.collect()} == {1: ["m"], 2: []}
    assert [tuple(r) for r in lacking.collect()] == [("m", 2)] and [tuple(r) for r in counts.collect()] == [("m", 1)]
    assert annotation.augment(base, [])[0].count() == 2


def test_boundaries(spark):
    t = 'A b. C? d!\nE." F "G. "'
    got = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(text.boundaries(F.col("t")).alias("b")).collect()
    pattern = [m.end() - 1 for p in (r"\. ", r"\.\n", r"\? ", r"\?\n", "! ", r"!\n", r'\." ', r'\?" ', '!" ') for m in regex.finditer(p, t)]
    assert [r.b for r in got] == [sorted(set(pattern)), [], []]


def test_greedy_match_is_that_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=(1 + k % 5, 3)).tolist(), rng.normal(size=(1 + k % 7, 3)).tolist()) for k in range(40)]
    odd = [(100, [[0.0, 0.0, 0.0]], [[1.0, 0.0, 0.0]]), (101, None, [[1.0]]), (102, [], [[1.0]]), (103, [[1.0, None]], [[1.0, 2.0]]), (104, [[1.0], [1.0, 2.0]], [[1.0]]), (105, [[1.0]], [[1.0, 2.0]]), (106, [[]], [[]])]
    df = spark.createDataFrame(rows + odd, "k int, r array<array<double>>, g array<array<double>>").repartition(3)
    got = {r.k: r.s for r in df.select("k", metrics.greedy_match(F.col("r"), F.col("g")).alias("s")).collect()}
    for k, r, g in rows:
        cosines = [[np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) for y in g] for x in r]
        p, c = np.mean(np.max(cosines, 0)), np.mean(np.max(cosines, 1))
        assert (got[k].precision, got[k].recall) == pytest.approx((p, c)) and got[k].f1 == pytest.approx(2 * p * c / (p + c) if p + c > 0 else 0.0)
        monkeypatch.setattr(metrics, "CELLS", 4)
        assert metrics.best_cosines(*(np.array(x) / np.linalg.norm(x, axis=1)[:, None] for x in (r, g))) == pytest.approx((p, c))
    assert tuple(got[100]) == (0.0, 0.0, 0.0)
    assert all(got[k].precision is None and got[k].recall is None for k in range(101, 107))
