"""Queries over annotations, generation runs and training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import text
from tarnwell.functions.adapters import REGISTRY, ModelConfig, configs, generate, run_generation
from tarnwell.operators import annotation, evaluation, prompts, relations
from tarnwell.operators.ledger import Ledger
from tarnwell.plans.registry import query
from tarnwell.sources.scratch import scratch


def _annotated(t):
    """Labels as annotations: the source as model, flags from their wording."""
    rows = t.labels.join(t.documents, "doc_id")
    word = F.when(F.col("toxic") == 1, "Hallucination present").otherwise("fine")
    ok = F.when(F.col("quality") == 1, "Publishable as is").otherwise("rejected")
    return rows.select(
        F.col("lang").alias("case_id"), F.concat(F.lit("pr"), F.col("doc_id").cast("string")).alias("press_id"), F.col("source").alias("model_name"), (F.col("doc_id") % 11 + 1).alias("rank"),
        text.annotation_flag("hallucination", word).alias("hallucination"), text.annotation_flag("incoherent", word).alias("incoherent"), text.annotation_flag("publishable", ok).alias("publishable"),
    )


_ROWS = "r AS (SELECT lang AS case_id, 'pr' || doc_id AS press_id, source AS model_name, doc_id % 11 + 1 AS rank, toxic = 1 AS hallucination, false AS incoherent, quality = 1 AS publishable FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {_ROWS} SELECT model_name AS model, count(*) AS count, round(avg(rank), 9) AS avg_rank, array_to_string(list_sort(list(rank)), ',') AS ranks, round(avg(hallucination::INT), 9) AS hallucination_rate,
round(avg(incoherent::INT), 9) AS incoherent_rate, round(avg(publishable::INT), 9) AS publishable_rate FROM r GROUP BY ALL""")
def a10_model_metrics(t):
    out = annotation.model_metrics(_annotated(t)).withColumn("ranks", F.array_join("ranks", ","))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("avg_") or c.endswith("_rate")})


@query(f"WITH {_ROWS} SELECT case_id, string_agg(press_id || ':' || rank, ',' ORDER BY rank, press_id) AS items FROM r GROUP BY case_id")
def a11_nested_rank(t):
    nested = annotation.by_case(_annotated(t))
    return nested.select("case_id", F.array_join(F.transform("press_items", lambda x: F.concat(x["press_id"], F.lit(":"), x["rank"].cast("string"))), ",").alias("items"))


@query(f"WITH {_ROWS} SELECT model_name AS model, count(*) AS n FROM r GROUP BY ALL")
def a12_model_counts(t):
    return annotation.by_case(_annotated(t)).select(F.explode("press_items").alias("i")).groupBy(F.col("i.model_name").alias("model")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ALL")
def a13_distribution(t):
    return t.customer.where("c_mktsegment IS NOT NULL").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _cases(t):
    return t.conversations.groupBy(F.col("conv_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("model_name"), x["text"].alias("body"))).alias("items"))


@query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, text FROM conversations)
SELECT conv_id AS case_id, 'pr' || k AS press_id, role AS model_name, md5('PR-' || k || E'\\n\\n' || text) AS press_md5 FROM c""")
def c3_annotation_tasks(t):
    tasks, mapping = annotation.tasks(_cases(t), "case_id", "items")
    flat = tasks.select("case_id", F.explode("press").alias("name", "body")).select("case_id", F.regexp_replace("name", "^press", "pr").alias("press_id"), F.md5("body").alias("press_md5"))
    return mapping.join(flat, ["case_id", "press_id"])


@query()
def w8_shuffled_tasks(t):
    return annotation.tasks(_cases(t), "case_id", "items", 42)[1]


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role FROM conversations)
SELECT conv_id::VARCHAR AS case_id, 'pr' || k AS press_id, coalesce(CASE WHEN k <> 2 THEN role END, 'UNKNOWN') AS model_name, CAST(k AS INT) AS rank, (k % 2 = 0) AS hallucination, false AS incoherent, (k % 3 = 0) AS publishable FROM c""")
def c4_process_results(t):
    """Annotations made of conversations, each there twice: the later one has the ranking that counts."""
    ids = t.conversations.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    ranks = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("pr"), i.cast("string")))
    flags = F.map_from_arrays(ranks, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.when(i % 2 == 0, "Outside of case").otherwise("ok").alias("hallucination"), F.lit("fine").alias("incoherent"), F.when(i % 3 == 0, "not publishable").otherwise("no").alias("publishable"))))
    made = ids.select(F.col("conv_id").cast("string").alias("case_id"), F.col("conv_id").alias("id"), ranks.alias("rank"), flags.alias("flags"))
    early = made.withColumns({"updated_at": F.lit("2024-01-01T00:00:00Z"), "_row_id": F.lit(0), "rank": F.array(F.lit("pr1"))})
    late = made.withColumns({"updated_at": F.lit("2024-01-02T00:00:00Z"), "_row_id": F.lit(1)})
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    mapping = t.conversations.select(F.col("conv_id").cast("string").alias("case_id"), F.row_number().over(order).alias("k"), F.col("role").alias("model_name")).where("k <> 2").select("case_id", F.concat(F.lit("pr"), F.col("k").cast("string")).alias("press_id"), "model_name")
    both = early.unionByName(late)
    # cases have different numbers of turns: the expected number is each case's own
    rows, _ = annotation.process(both, mapping, F.size("flags"))
    return rows.select("case_id", "press_id", "model_name", "rank", *annotation.FLAGS)


@query("SELECT lang AS model, count(*) AS n, count(*) FILTER (n_chars = 0) AS errors FROM documents GROUP BY ALL")
def p17_valid_generation(t):
    rows = t.documents.withColumn("error", evaluation.generated_error(F.col("text")))
    return rows.groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("n"), F.sum(F.col("error").isNotNull().cast("long")).alias("errors"))


@query("SELECT doc_id, 'echo' AS model, md5('[' || left(sha256('Write about ' || lang), 8) || '] ' || left(text, 600)) AS generated_md5 FROM documents WHERE doc_id % 3 <> 0")
def c6_generation(t):
    """Open rows of one model, generated by the offline stand-in."""
    done = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("echo").alias("model"))
    open_ = relations.open_work(t.documents.select("doc_id", "text", F.concat(F.lit("Write about "), "lang").alias("prompt")), ["echo"], done, "doc_id")
    made = generate(open_, ModelConfig("echo"), "doc_id", "text", "prompt")
    return made.select("doc_id", "model", F.md5("generated").alias("generated_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, md5('User: ' || lang || chr(10) || chr(10) || 'Gerichtsurteil: ' || text || chr(10) || chr(10) || 'Assistant: ') AS prompt_md5, source AS completion FROM documents")
def c11_training_data(t):
    rows = t.documents.withColumn("split_name", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))
    made = prompts.training_rows(rows, "doc_id", "lang", "text", "source", split="split_name")
    return made.select("doc_id", "split", F.md5("prompt").alias("prompt_md5"), "completion")


@query("""SELECT source AS model, CASE WHEN lang IN ('en', 'de') THEN 'full' ELSE 'hier' END AS eval_type, max(n_chars) AS chars, max(doc_id) AS ids FROM documents GROUP BY ALL""")
def s14_pivot_metrics(t):
    rows = t.documents.groupBy(F.col("source").alias("model"), F.when(F.col("lang").isin("en", "de"), "full").otherwise("hier").alias("eval_type")).agg(F.max("n_chars").alias("chars"), F.max("doc_id").alias("ids"))
    long = rows.unpivot(["model", "eval_type"], ["chars", "ids"], "metric", "value")
    return evaluation.pick_metrics(long, ["chars", "ids"])


def _cases_sample(t, n):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("subset_name"), F.col("source").alias("synthetic_prompt"), F.col("text").alias("judgement"), F.md5("text").alias("summary"), "n_chars")
    return annotation.prepare(rows, n)


@query("SELECT lang AS subset_name, least(count(*), 25) AS n, least(count(*), 25) AS sound FROM documents WHERE lang IS NOT NULL GROUP BY ALL")
def c1_prepare_sample(t):
    """The sample's distribution, and how many of its rows are the documents they say they are."""
    sample, distribution = _cases_sample(t, 25)
    real = sample.join(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("own"), "lang"), "id").where("own = judgement AND lang = subset_name AND md5(own) = summary")
    return distribution.join(real.groupBy("subset_name").agg(F.countDistinct("id").alias("sound")), "subset_name")


@query("""SELECT doc_id AS id, concat_ws(';', CASE WHEN quality IS NOT NULL THEN 'm_quality=q' || quality || '/full' END, CASE WHEN toxic = 1 THEN 'm_toxic=t1/hier' END) AS models FROM documents LEFT JOIN labels USING (doc_id)""")
def c2_augment(t):
    """All documents as cases with the summaries of two models; a third one has no table."""
    base = _cases_sample(t, 1 << 30)[0]
    q = t.labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("m_quality"), "toxic")
    x = t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("t1").alias("m_toxic"))
    out, _, _ = annotation.augment(base, [("m_quality", "full", q), ("absent", "full", None), ("m_toxic", "hier", x)])
    return out.select("id", F.array_join(F.transform("model_summaries", lambda m: F.concat(m["model_name"], F.lit("="), m["summary"], F.lit("/"), m["category"])), ";").alias("models"))


@query("SELECT 'm_quality' AS model_name, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) UNION ALL SELECT 'm_toxic', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def c2_missing(t):
    """The cases that each model lacks."""
    base = _cases_sample(t, 1 << 30)[0]
    q = t.labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("id"), F.lit("q").alias("m_quality"))
    x = t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("t").alias("m_toxic"))
    return annotation.augment(base, [("m_quality", "full", q), ("m_toxic", "hier", x)])[1]


#: Documents with a null id for each seventh and a copy of each fifth: rows that ids can't tell apart.
_PLANTED = "d AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id, text, lang, source FROM documents UNION ALL SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END, text, lang, source FROM documents WHERE doc_id % 5 = 0)"


def _planted(t):
    rows = t.documents.select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("doc_id"), "text", F.concat(F.lit("Write about "), "lang").alias("ask"), "source", (F.col("doc_id") % 5 == 0).alias("twice"))
    return rows.unionByName(rows.where("twice")).drop("twice")


#: The stand-in with whole texts.
WHOLE = {"max_chars": 1 << 30}
_ANSWER = r"regexp_replace('[' || left(sha256('Write about ' || lang), 8) || '] ' || text, '[\s\x{00A0}]+$', '')"


@query(f"WITH {_PLANTED} SELECT doc_id, m AS model, CASE WHEN m = 'old' AND doc_id % 3 = 0 THEN 'kept' ELSE md5({_ANSWER}) END AS generated, source AS reference_press, '' AS error FROM d, (SELECT unnest(['echo', 'old']) AS m) WHERE m = 'echo' OR doc_id % 3 IS DISTINCT FROM 0 UNION ALL SELECT DISTINCT doc_id, 'old', 'kept', source, '' FROM d WHERE doc_id % 3 = 0")
def c6_generation_run(t):
    """Two models over all documents, null and repeated ids among them; what is there of a third of one model's ids stays."""
    rows = _planted(t)
    done = rows.where("doc_id % 3 = 0").select("doc_id", F.lit("old").alias("model"), F.lit("kept").alias("generated_press"), F.col("source").alias("reference_press"), F.lit("").alias("error"), F.lit("p").alias("prompt")).distinct()
    made = run_generation(rows, [ModelConfig("echo", options=WHOLE), ModelConfig("old", options=WHOLE)], "doc_id", "text", "ask", "source", done)
    return made.select("doc_id", "model", F.when(F.col("generated_press") == "kept", "kept").otherwise(F.md5("generated_press")).alias("generated"), "reference_press", "error")


@query(f"WITH {_PLANTED}, c AS (SELECT count(DISTINCT (text, lang)) AS n FROM d) SELECT doc_id, m AS model, md5({_ANSWER}) AS generated, source AS reference_press, '' AS error, n AS calls FROM d, c, (SELECT unnest(['echo', 'old']) AS m)")
def c6_call_ledger(t):
    """Two models over rows that ids can't tell apart, by a ledger, then once more; the calls of each model are its different requests, though both runs and the result ask for all."""
    ledger = Ledger(t.spark, f"{scratch(t.spark)}/calls")
    models = [ModelConfig("echo", options=WHOLE), ModelConfig("old", options=WHOLE)]
    run_generation(_planted(t), models[:1], "doc_id", "text", "ask", "source", ask=ledger.ask)
    made = run_generation(_planted(t), models, "doc_id", "text", "ask", "source", ask=ledger.ask)
    calls = ledger.calls().groupBy("model").agg(F.count("*").alias("calls"))
    return made.join(F.broadcast(calls), "model").select("doc_id", "model", F.md5("generated_press").alias("generated"), "reference_press", "error", "calls")  # a row for each model


@query("SELECT item_id, lang AS model, replace(text, 'e', 'E') || '/' || lang AS generated FROM benchmark, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def c13_registered_kind(t):
    """Models by their records, one for each language, of a kind that is registered here and runs on executors."""

    class Loud:
        def __init__(self, config):
            self.ending = config.options["ending"]

        def generate(self, ruling, prompt):
            return ruling.replace("e", "E") + self.ending

    REGISTRY["loud"] = Loud
    records = [{"name": r.lang, "type": "loud", "ending": f"/{r.lang}"} for r in t.documents.where("lang IS NOT NULL").select("lang").distinct().limit(1000).collect()]
    parts = [generate(t.benchmark.withColumn("p", F.lit("")), c, "item_id", "text", "p") for c in configs(records)]
    return reduce(DataFrame.unionByName, parts).select("item_id", "model", "generated")


@query("""SELECT model, round(avg(n_chars), 6) AS chars, NULL AS rouge, count(*) FILTER (n_chars > 500) / count(*) AS success_rate FROM (SELECT source AS model, CASE WHEN n_chars > 500 THEN n_chars END AS n_chars FROM documents) GROUP BY model""".replace("NULL AS rouge, ", ""))
def c8_results_table(t):
    """The result table of a summary: metrics without prefix, those that no model has left out."""
    rows = t.documents.select(F.col("source").alias("model"), F.col("n_chars").cast("double").alias("chars"), F.lit(None).cast("double").alias("rouge1_recall"), F.when(F.col("n_chars") <= 500, "short").alias("error"))
    return evaluation.results_table(evaluation.summary(rows, "model", ["rouge1_recall", "chars"])).withColumn("chars", F.round("chars", 6))
