"""Evaluation of generated texts: metric table, resumable runs, summaries, result tables, ranking, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import metrics as mx
from tarnwell.functions import text as tx
from tarnwell.operators.ranking import first_rows, top_rows
from tarnwell.operators.selection import quantiles
from tarnwell.sources.scratch import settled
from tarnwell.sources.tables import append_results, path_exists

# The error of rows without a generated text, of models without a column and of models without a valid row; the metrics that summaries list.
NO_TEXT = "Kein generierter Text verfügbar"
NO_COLUMN = "Spalte '{}' nicht im Dataset gefunden"
NO_VALID = "Keine gültigen Ergebnisse gefunden"
ROUGE = [f"rouge{k}_{part}" for k in ("1", "2", "L") for part in ("precision", "recall", "fmeasure")]
BLEU = ["bleu1", "bleu2", "bleu3", "bleu4"]
BERTSCORE = ["bertscore_precision", "bertscore_recall", "bertscore_f1"]
OVERLAP = ["keyword_overlap", "entity_overlap", "length_ratio", "semantic_similarity"]
FACTUAL = ["qags_score", "qags_question_count", "qags_valid_answers", "factcc_score", "factcc_consistency_ratio", "factcc_claim_count"]
JUDGE = [f"llm_judge_{f}" for f in [*tx.JUDGE_FIELDS, "gesamtscore"]]
METRICS = [*ROUGE, *BLEU, "meteor", *BERTSCORE, *OVERLAP, *FACTUAL, *JUDGE]
#: Groups of metrics in the order of result tables, and parts of a group in their order.
GROUPS = ["other", "overlap", "rouge1", "rouge2", "rougel", "rouge", "bleu1", "bleu2", "bleu3", "bleu4", "bleu", "meteor", "bertscore", "factcc", "qags", "llm_judge"]
PARTS = {"precision": 1, "recall": 2, "fmeasure": 3, "f1": 3, "score": 4}
# End of fixed values.

#: Tasks for each core that a step of a run is dealt to.
STEP_TASKS = 4


@dataclass(frozen=True)
class Adapters:
    """Models behind the metrics, as column functions, one as a function of Arrow arrays; a metric whose model is absent is null."""

    token_vectors: Callable[[Column], Column] | None = None  # words -> their vectors
    entities: Callable[[Column], Column] | None = None  # text -> array of (text, label)
    questions: Callable[[Column], Column] | None = None  # generated text -> a model's questions, a line each
    answers: Callable[[Column, Column], Column] | None = None  # questions, text -> an answer to each
    classify: Callable[[Column, Column], Column] | None = None  # source, claim -> score
    judge: Callable[[Column, Column, Column], Column] | None = None  # source, generated, reference -> answer with JSON
    vectors: Callable[[pa.Array], pa.Array] | None = None  # in place of token_vectors: Arrow lists of words -> their vectors, made and used within the task


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, reference, generated, model: each turn's text with the next one's, by the next one's role."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    paired = conversations.select("conv_id", "turn", F.col("text").alias("reference"), F.lead("text").over(by).alias("generated"), F.lead("role").over(by).alias("model"))
    return paired.where(F.col("model").isNotNull())


def generated_error(generated: Column) -> Column:
    """The error of a missing or empty generated text, else null."""
    return F.when(generated.isNull() | (generated == ""), NO_TEXT)


def score(pairs: DataFrame, reference: str = "reference", generated: str = "generated", source: str | None = None, adapters: Adapters = Adapters(), stem: bool = True) -> DataFrame:
    """pairs with all METRICS, entity precision, recall and f1, error columns and error, worked out within each row.

    Metrics are null where the row has an error, and where a model or the source is absent;
    a factual metric that fails is NaN and its own error says why.
    """
    whole_r, g = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(generated), F.lit(""))
    none = F.lit(None)
    out = pairs.withColumn("error", generated_error(F.col(generated)))
    # a reference without a generated text is not cut into words: no metric of the row is shown
    r = F.when(F.col("error").isNull(), whole_r).otherwise("")
    # words are cut once for all metrics that take them
    out = out.withColumns({"_wr": tx.words(r), "_wg": tx.words(g)})
    wr, wg = F.col("_wr"), F.col("_wg")
    out = out.withColumns({"_r": mx.rouge_words(r) if stem else wr, "_g": mx.rouge_words(g) if stem else wg})
    out = out.withColumns({"_rouge": mx.rouge_n(F.col("_r"), F.col("_g")), "_lcs": mx.rouge_l(F.col("_r"), F.col("_g")), "_bleu": mx.bleu(r, g), "_entity": tx.precision_recall(adapters.entities(r), adapters.entities(g)) if adapters.entities else none})
    values = {f"rouge{k}_{part}": F.col("_rouge")[k - 1][part] for k in (1, 2) for part in ("precision", "recall", "fmeasure")}
    values |= {f"rougeL_{part}": F.col("_lcs")[part] for part in ("precision", "recall", "fmeasure")}
    values |= {b: F.col("_bleu")[b] for b in BLEU}
    values |= {"meteor": mx.meteor(wr, wg), "keyword_overlap": mx.keywords_shared(wr, wg), "entity_overlap": tx.entity_overlap(r, g), "length_ratio": tx.length_ratio(r, g)}
    if adapters.entities:
        # a side without text scores nothing at all
        both = (r != "") & (g != "")
        values |= {f"entity_{part}": F.when(both, F.col("_entity")[part]).otherwise(0.0) for part in ("precision", "recall", "f1")}
    if adapters.vectors:
        out = out.withColumn("_bert", mx.vector_scores(wr, wg, adapters.vectors))
        values |= {f"bertscore_{part}": F.col("_bert")[part] for part in ("precision", "recall", "f1")}
        values["semantic_similarity"] = F.col("_bert")["similarity"]
    elif adapters.token_vectors:
        out = out.withColumns({"_vr": adapters.token_vectors(wr), "_vg": adapters.token_vectors(wg)})
        full = (F.size("_vr") > 0) & (F.size("_vg") > 0)
        out = out.withColumn("_bert", F.when(full, mx.greedy_match(F.col("_vr"), F.col("_vg"))))
        values |= {f"bertscore_{part}": F.col("_bert")[part] for part in ("precision", "recall", "f1")}
        values["semantic_similarity"] = F.when(full, mx.semantic_similarity(F.col("_vr"), F.col("_vg")))
    errors = {}
    if source is not None:
        s = F.coalesce(F.col(source), F.lit(""))
        if adapters.questions and adapters.answers:
            out = out.withColumn("_q", tx.questions(adapters.questions(g)))
            out = out.withColumn("_qags", mx.question_scores(F.col("_q"), adapters.answers(F.col("_q"), s), adapters.answers(F.col("_q"), g)))
            values |= {f"qags_{part}": F.col("_qags")[part] for part in ("score", "question_count", "valid_answers")}
            errors["qags_error"] = F.col("_qags")["error"]
        if adapters.classify:
            out = out.withColumn("_factcc", mx.claim_scores(s, g, adapters.classify))
            values |= {f"factcc_{part}": F.col("_factcc")[part] for part in ("score", "consistency_ratio", "claim_count")}
            errors["factcc_error"] = F.col("_factcc")["error"]
        if adapters.judge:
            out = out.withColumn("_answer", adapters.judge(s, g, whole_r))
            out = out.withColumn("_judge", tx.judge_scores(F.col("_answer")))
            whole = tx.judge_error(F.col("_answer")).isNull()
            values |= {f"llm_judge_{f}": F.when(whole, F.col("_judge")[f]) for f in [*tx.JUDGE_FIELDS, "gesamtscore"]}
            errors["llm_judge_error"] = tx.judge_error(F.col("_answer"))
    fine = F.col("error").isNull()
    extra = [f"entity_{part}" for part in ("precision", "recall", "f1")]
    out = out.withColumns({m: F.when(fine, values.get(m, none).cast("double")).cast("double") for m in [*METRICS, *extra]} | {e: F.when(fine, errors.get(e, none)).cast("string") for e in ("qags_error", "factcc_error", "llm_judge_error")})
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in pairs.columns])


def summary(scored: DataFrame, model: str, names: list[str] = METRICS) -> DataFrame:
    """model, avg_* over rows without error, total, successful and failed counts, success_rate and error.

    NaN stays NaN, null is left out. A model without a valid row has the error instead of averages.
    """
    fine = F.col("error").isNull()
    averages = [F.avg(F.when(fine, F.col(m))).alias(f"avg_{m}") for m in names]
    ok = F.sum(fine.cast("long"))
    return scored.groupBy(model).agg(*averages, F.count("*").alias("total_samples"), ok.alias("successful_generations"), F.sum((~fine).cast("long")).alias("failed_generations"), (ok / F.count("*")).alias("success_rate"), F.when(ok == 0, NO_VALID).alias("error"))


def to_score(wide: DataFrame, row_id: str, reference: str, models: list[str], done: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """A row (row_id, reference, source, model, generated) for each model column that wide has, less what done (model, row_id) holds."""
    known = [m for m in models if m in wide.columns]
    kept = [row_id, reference, *([source] if source and source not in (row_id, reference) else [])]
    if not known:
        schema = f"{', '.join(f'`{c}` {t}' for c, t in wide.select(*kept).dtypes)}, model string, generated string"
        return wide.sparkSession.createDataFrame([], schema)
    long = wide.select(*kept, *[F.col(m).cast("string").alias(m) for m in known]).unpivot(kept, known, "model", "generated")
    if done is None:
        return long
    have = done.select(F.col("model").alias("_model"), F.col(row_id).alias("_row")).distinct()
    return long.join(have, (F.col("model") == F.col("_model")) & F.col(row_id).eqNullSafe(F.col("_row")), "left_anti")


def lost_models(wide: DataFrame, models: list[str]) -> DataFrame:
    """model and error of the models that have no column."""
    return wide.sparkSession.createDataFrame([(m, NO_COLUMN.format(m)) for m in models if m not in wide.columns], "model string, error string")


def evaluate(wide: DataFrame, row_id: str, reference: str, models: list[str], done: DataFrame | None = None, source: str | None = None, adapters: Adapters = Adapters(), stem: bool = True) -> tuple[DataFrame, DataFrame]:
    """Scored rows (row_id, model, generated, metrics, error) of all model columns, and their summary.

    done: scored rows of an earlier run; what they hold is not scored again, and they count in
    the summary. Models without a column have no rows, and a summary with an error alone.
    With adapters the scored rows are written first, so that rows and summary together call
    each model once.
    """
    scored = score(to_score(wide, row_id, reference, models, done, source), reference, "generated", source, adapters, stem)
    if adapters != Adapters():
        scored = settled(scored)
    if done is not None:
        scored = done.select(*scored.columns).unionByName(scored)
    return scored, summary(scored, "model").unionByName(lost_models(wide, models), allowMissingColumns=True)


def run(wide: DataFrame, row_id: str, reference: str, models: list[str], folder: str, every: int, source: str | None = None, adapters: Adapters = Adapters(), stem: bool = True, steps: int | None = None) -> DataFrame:
    """The summary of a run that adds its scored rows to folder after each `every` numbers; a run that was stopped goes on with what is missing.

    row_id: whole numbers. Steps are ranges of them, from the least to the greatest that the
    table has, and one for rows without a number. Each is scored alone and appended by model, so
    that the driver holds nothing and no row is written twice: what is there is looked up once,
    within the step's range. A step is appended whole, so rows of one number are all there or
    none. A step's rows are dealt evenly to all tasks before they are scored, as a table's files
    often hold a range of the numbers each, and then few of them have rows of a step.
    steps: ends the call after so many, as an interruption would.
    """
    spark = wide.sparkSession
    taken = wide.select(*dict.fromkeys([row_id, reference, *([source] if source else []), *[m for m in models if m in wide.columns]]))
    tasks = STEP_TASKS * spark.sparkContext.defaultParallelism
    done = spark.read.parquet(folder).select("model", row_id) if path_exists(spark, folder) else None
    n = F.col(row_id)
    least, most, unnumbered = wide.agg(F.min(n), F.max(n), F.sum(n.isNull().cast("long"))).first()
    ranges = [(n >= a) & (n < a + every) for a in range(least, most + 1, every)] if least is not None else []
    for part in [*ranges, *([n.isNull()] if unnumbered else [])][:steps]:
        left = to_score(taken.where(part).repartition(tasks), row_id, reference, models, None if done is None else done.where(part), source)
        append_results(score(left, reference, "generated", source, adapters, stem), folder)
    scored = spark.read.parquet(folder) if path_exists(spark, folder) else score(to_score(wide.limit(0), row_id, reference, models, None, source), reference, "generated", source, adapters, stem)
    return summary(scored, "model").unionByName(lost_models(wide, models), allowMissingColumns=True)


def metric_group(name: str) -> str:
    """The group of result tables that a metric belongs to."""
    low = name.lower()
    if "rouge" in low and not any(x in low for x in ("bert", "factcc", "qags", "llm")):
        return next((k for k in ("rouge1", "rouge2", "rougel") if k in low), "rouge")
    if "bertscore" in low:
        return "bertscore"
    if "bleu" in low:
        return next((k for k in BLEU if k in low), "bleu")
    named = next((k for k in ("meteor", "factcc", "qags", "llm_judge") if k in low), None)
    return named or ("overlap" if any(x in low for x in ("keyword", "entity", "length")) else "other")


def metric_order(names: list[str]) -> list[str]:
    """Metrics by group, within a group precision, recall, f, score and then all others by name."""
    part = lambda n: PARTS.get(n.rpartition("_")[2], 999) if "_" in n else 999
    return sorted(names, key=lambda n: (GROUPS.index(metric_group(n)), part(n), n))


def results_table(summaries: DataFrame) -> DataFrame:
    """model, the averages without their prefix in table order, and success_rate; metrics that no model has are left out."""
    names = [c.removeprefix("avg_") for c in summaries.columns if c.startswith("avg_")]
    held = summaries.agg(*[F.count(f"avg_{n}").alias(n) for n in names]).first()
    shown = metric_order([n for n in names if held[n]])
    return summaries.select("model", *[F.col(f"avg_{n}").alias(n) for n in shown], (F.col("successful_generations") / F.col("total_samples")).alias("success_rate"))


def success_rates(results: DataFrame, model: str, error: str) -> DataFrame:
    failed = F.sum((F.length(F.coalesce(error, F.lit(""))) > 0).cast("long"))
    return results.where(F.col(model).isNotNull()).groupBy(model).agg(F.count("*").alias("total"), failed.alias("errors"), ((F.count("*") - failed) * 100 / F.count("*")).alias("success_percent"))


def examples(scored: DataFrame, model: str, metric: str, row_id: str, k: int = 3) -> DataFrame:
    """The k best and k worst rows of each model, as kind best or worst."""
    valid = scored.where(F.col("error").isNull())
    return top_rows(valid, model, metric, row_id, k, True).withColumn("kind", F.lit("best")).unionByName(top_rows(valid, model, metric, row_id, k, False).withColumn("kind", F.lit("worst")))


def example_rows(scored: DataFrame, model: str, row_id: str, only: str | None = None, k: int | None = None) -> DataFrame:
    """Valid rows for export: of one model or all, the first k of each or all; columns without any value are left out."""
    valid = scored.where(F.col("error").isNull()).drop("error")
    valid = valid if only is None else valid.where(F.col(model) == only)
    held = valid.agg(*[F.count(c).alias(c) for c in valid.columns]).first()
    valid = valid.select(*[c for c in valid.columns if held[c] or c in (model, row_id)])
    return valid if k is None else first_rows(valid, model, row_id, k).drop("rank")


def ranked(metrics: DataFrame, value: str, ascending: bool = False) -> DataFrame:
    """Metrics by model with a place; the table has a row for each model."""
    by = Window.orderBy(F.asc(value) if ascending else F.desc(value), "model")
    return metrics.withColumn("place", F.row_number().over(by))


def figure_data(scored: DataFrame, model: str, names: list[str]) -> DataFrame:
    """model, metric, n, mean and the five quartile points of each metric: what bar and box figures show."""
    long = scored.where(F.col("error").isNull()).unpivot([model], [F.col(c).cast("double").alias(c) for c in names], "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    long = settled(long.withColumnRenamed(model, "model") if model != "model" else long)
    points = {"least": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "most": 1.0}
    means = long.groupBy("model", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    cut = quantiles(long, "value", points, ["model", "metric"]).withColumnsRenamed({"model": "_model", "metric": "_metric"})
    return means.join(cut, F.col("model").eqNullSafe(F.col("_model")) & (F.col("metric") == F.col("_metric"))).select("model", "metric", "n", "mean", *points)


def markdown_report(metrics: DataFrame, value: str = "avg_rank", most: int = 1000) -> str:
    """A ranking table of the models, best first."""
    rows = ranked(metrics, value, True).orderBy("place").limit(most).collect()
    names = [c for c in metrics.columns if c not in ("model", "ranks")]
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["# Model ranking", "", "| place | model | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 2)]
    return "\n".join(lines + [f"| {r['place']} | {r['model']} | " + " | ".join(show(r[c]) for c in names) + " |" for r in rows]) + "\n"


def html_report(metrics: DataFrame, shown: DataFrame, figures: DataFrame | None = None, most: int = 200) -> str:
    """A page with the metric table, the data of the figures and the example rows."""
    from html import escape

    def table(df: DataFrame) -> str:
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        return "<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + f"</tr>{body}</table>"

    parts = [("Evaluation", metrics), *([("Figures", figures)] if figures is not None else []), ("Examples", shown)]
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Evaluation</title></head><body>" + "".join(f"<h2>{name}</h2>{table(df)}" for name, df in parts) + "</body></html>"


def pick_metrics(long: DataFrame, names: list[str]) -> DataFrame:
    """One row by model and evaluation type with a column for each metric."""
    return long.groupBy("model", "eval_type").pivot("metric", names).agg(F.first("value"))
