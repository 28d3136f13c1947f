"""Queries that write tables in each format, read them back and show what came through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import text
from tarnwell.functions.adapters import ModelConfig, generate, not_done, run_generation
from tarnwell.operators import annotation, cleaning, evaluation, prompts
from tarnwell.plans.registry import query
from tarnwell.sources import config, tables
from tarnwell.sources.scratch import scratch, settled


def _orders(t) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").cast("string").alias("cust"))


def _lines(t, name: str, line, rows: DataFrame | None = None, head: str = "id,state,cust") -> str:
    """A folder of text files of CSV lines made of the orders, or of other rows, in a folder of its own; each file, as each one of a real folder, has the header."""
    path = f"{scratch(t.spark)}/{name}"
    # many tasks write: the first row of a task brings its file's header along
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    made = (t.orders if rows is None else rows).select(line.alias("line")).select(F.concat(F.when(first, F.lit(f"{head}\n")).otherwise(F.lit("")), F.coalesce("line", F.lit(""))).alias("value"))
    if made.isEmpty():
        made = t.spark.createDataFrame([(head,)], "value string")
    made.write.text(path)
    return path


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'cleaned' END AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL")
def s2_split_folder(t):
    """A folder with cleaned.csv and removed.csv, as one table with the status."""
    folder = scratch(t.spark)
    tables.write_csv(_orders(t).where("state <> 'P'"), f"{folder}/cleaned.csv")
    tables.write_csv(_orders(t).where("state = 'P'"), f"{folder}/removed.csv")
    return tables.read_split_status(t.spark, folder).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("keys"))


@query("SELECT f AS format, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(DISTINCT o_orderstatus) AS states FROM orders, (SELECT unnest(['csv', 'json', 'jsonl', 'parquet']) AS f) GROUP BY f")
def s4_formats(t):
    """The same table through each format, read by its ending."""
    folder, made = scratch(t.spark), []
    for kind in ("csv", "json", "jsonl", "parquet"):
        path = f"{folder}/orders.{kind}"
        write = {"csv": tables.write_csv, "json": tables.save_json, "jsonl": tables.write_jsonl, "parquet": lambda df, p: df.write.parquet(p)}[kind]
        write(_orders(t), path)
        made.append(tables.read_table(t.spark, path).select(F.lit(kind).alias("format"), "id", "state"))
    whole = made[0].union(made[1]).union(made[2]).union(made[3])
    return whole.groupBy("format").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("keys"), F.countDistinct("state").alias("states"))


@query("SELECT o_orderkey AS id, o_orderstatus AS state, CASE WHEN o_orderkey % 5 <> 1 THEN o_custkey END AS cust FROM orders WHERE o_orderkey % 5 <> 0")
def s5_tolerant(t):
    """Lines with a field too many go, lines with one too few are filled up."""
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 1, F.col("o_custkey")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("more")))
    return tables.read_tolerant(t.spark, _lines(t, "tolerant", line)).select(F.col("id").cast("long"), "state", F.col("cust").cast("long"))


@query("SELECT o_orderkey AS id, o_orderstatus AS state, o_custkey AS cust FROM orders WHERE o_orderkey % 5 > 1")
def s6_arity(t):
    """Only records with the header's number of fields, whatever stands in their quotes."""
    line = F.concat_ws(",", "o_orderkey", F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), F.when(F.col("o_orderkey") % 5 != 1, F.col("o_custkey")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("more")))
    return tables.read_arity(t.spark, _lines(t, "arity", line)).select(F.col("id").cast("long"), "state", F.col("cust").cast("long"))


@query("""SELECT o_orderkey AS id, '"' || o_orderstatus AS state, o_custkey AS cust FROM orders""")
def s7_plain_quotes(t):
    """Open quotes are plain characters for the reader without quoting."""
    line = F.concat_ws(",", "o_orderkey", F.concat(F.lit('"'), "o_orderstatus"), "o_custkey")
    return tables.read_plain(t.spark, _lines(t, "plain", line), None).select(F.col("id").cast("long"), "state", F.col("cust").cast("long"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'run_5.csv' WHEN o_orderkey % 3 = 1 THEN 'run_10.csv' ELSE 'run_7.csv' END AS file, count(*) AS n, o_orderkey % 3 = 1 AS latest FROM orders GROUP BY ALL")
def s9_checkpoints(t):
    """All matching files with their rows, and which of them is the latest by number."""
    folder = scratch(t.spark)
    for k, end in enumerate((5, 10, 7)):
        tables.write_csv(_orders(t).where(F.col("id").cast("long") % 3 == k), f"{folder}/run_{end}.csv")
    # the files are read once: which is the latest is told from their counts
    files = settled(tables.read_glob(t.spark, folder, "run_*.csv").groupBy("file").agg(F.count("*").alias("n")))
    last = tables.latest_checkpoint(files).select("file", F.lit(True).alias("latest"))
    return files.join(last, "file", "left").withColumn("latest", F.coalesce("latest", F.lit(False)))


@query("SELECT o_orderstatus AS state, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def s10_merged_json(t):
    """JSON lists of records as one table; a file that is none is skipped."""
    folder = scratch(t.spark)
    for state in ("F", "O"):
        tables.save_json(_orders(t).where(F.col("state") == state), f"{folder}/{state}.json")
    t.spark.createDataFrame([("no list",)], "value string").write.text(f"{folder}/note.json")
    tables.merge_json_into(t.spark, [f"{folder}/{x}.json" for x in ("F", "note", "O")], f"{folder}/all.jsonl")
    return tables.read_table(t.spark, f"{folder}/all.jsonl").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (0, 'id'), (1, 'state'), (2, 'cust')) v(place, name)")
def s12_header(t):
    """Column names of a CSV, without its rows."""
    path = f"{scratch(t.spark)}/orders.csv"
    tables.write_csv(_orders(t), path)
    return t.spark.createDataFrame([*enumerate(tables.header_of(t.spark, path))], "place int, name string")


@query("""WITH v AS (SELECT source AS model, CASE WHEN n_chars > 300 THEN n_chars END AS x FROM documents)
SELECT model, round(avg(x), 6) AS avg_chars, count(x) AS successful_generations, count(*) AS rows_there FROM v GROUP BY model""")
def s13_evaluation_folder(t):
    """Summary and details of an evaluation, written and loaded again."""
    folder = scratch(t.spark)
    scored = t.documents.select("doc_id", F.col("source").alias("model"), F.col("n_chars").cast("double").alias("chars"), F.when(F.col("n_chars") <= 300, "short").alias("error"))
    tables.write_evaluation(scored, lambda rows: evaluation.summary(rows, "model", ["chars"]), folder, "doc_id")
    summaries, details = tables.load_evaluation(t.spark, folder)
    counts = details.groupBy("model").agg(F.count("*").alias("rows_there"))
    return summaries.join(counts, "model").select("model", F.round("avg_chars", 6).alias("avg_chars"), "successful_generations", "rows_there")


@query("SELECT * FROM (VALUES ('chunk_size', 512), ('max_context_length', 4096), ('max_summary_length', 700), ('num_attempts', 3)) v(name, value)")
def s16_settings(t):
    """Defaults, overridden in two places."""
    s = config.load(None, {"chunking": {"chunk_size": 512}, "summarization": {"max_summary_length": 700}})
    rows = [("chunk_size", s.chunking.chunk_size), *((n, getattr(s.summarization, n)) for n in ("max_context_length", "max_summary_length", "num_attempts"))]
    return t.spark.createDataFrame(rows, "name string, value int")


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL")
def k1_by_status(t):
    """One folder for each status, the column in the folder's name."""
    folder = scratch(t.spark)
    tables.write_by(_orders(t).withColumnRenamed("state", "status"), folder, "status", "csv")
    return t.spark.read.options(**tables.CSV).csv(folder).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("keys"))


@query(r"""SELECT o_orderkey AS id, 'say "' || o_orderstatus || '", \n or \\' || o_custkey || chr(10) || 'end\' AS note FROM orders""")
def k3_quoted(t):
    """Quotes, commas, line breaks and backslashes come back as they went."""
    path = f"{scratch(t.spark)}/notes.csv"
    note = F.concat(F.lit('say "'), "o_orderstatus", F.lit('", \\n or \\\\'), "o_custkey", F.lit("\nend\\"))
    tables.write_csv(t.orders.select("o_orderkey", note.alias("note")), path, backslash=True)
    return tables.read_csv(t.spark, path, backslash=True).select(F.col("o_orderkey").cast("long").alias("id"), "note")


_STEPS = "m AS (SELECT max(o_orderkey) + 1 AS total, (max(o_orderkey) + 1) // 10 + 1 AS b FROM orders)"


def _batches(t) -> tuple[int, int]:
    """One more than the greatest order key, and a tenth of it."""
    total = t.orders.agg(F.max("o_orderkey")).first()[0] + 1
    return total, total // 10 + 1


@query(f"WITH {_STEPS} SELECT o_orderkey AS row_id, 'done ' || o_orderstatus AS result, 'run_' || CASE WHEN o_orderkey < 3 * b THEN 3 * b WHEN o_orderkey < 6 * b THEN 6 * b WHEN o_orderkey < 9 * b THEN 9 * b ELSE total END || '.csv' AS file FROM orders, m")
def k5_run_in_steps(t):
    """A run over all orders in ten batches, with a checkpoint after every third and at the end; the second call finds it all done."""
    folder = scratch(t.spark)
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    ends = tables.checkpoint_ends(*_batches(t), 3)
    step = lambda df: df.select("row_id", F.concat(F.lit("done "), "o_orderstatus").alias("result"))
    tables.run_in_steps(rows, "row_id", ends, step, folder, "run")
    again = tables.run_in_steps(rows, "row_id", ends, lambda df: df.select("row_id", F.lit("anew").alias("result")), folder, "run")
    made = tables.read_glob(t.spark, folder, "run_*.csv").select(F.col("row_id").cast("long"), "result", "file")
    return made.join(again.select(F.col("row_id").cast("long")), "row_id", "left_semi")


@query(f"WITH {_STEPS} SELECT 'run_' || unnest([3 * b, 6 * b, 9 * b, total]) || '.csv' AS name FROM m")
def k5_names(t):
    """Names of the checkpoints of that run."""
    return t.spark.createDataFrame([(n,) for n in tables.checkpoint_names("run", *_batches(t), 3)], "name string")


@query("SELECT m AS model, count(*) AS by_model, count(*) AS in_all FROM documents, (SELECT unnest(['a', 'b']) AS m) GROUP BY m")
def k6_generation_files(t):
    """Results of two models: in a folder each, and all together."""
    folder = scratch(t.spark)
    rows = t.documents.select("doc_id", F.col("text").alias("ruling"), F.lit("Write").alias("ask"), F.lit("press").alias("press"))
    tables.write_generation(run_generation(rows, [ModelConfig("a"), ModelConfig("b")], "doc_id", "ruling", "ask", "press"), folder)
    count = lambda path, name: t.spark.read.options(**tables.CSV).csv(path).groupBy("model").agg(F.count("*").alias(name))
    return count(f"{folder}/by_model", "by_model").join(count(f"{folder}/all_models_results", "in_all"), "model")


def _cases(t) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("model_name"), x["text"].alias("body")))
    return t.conversations.groupBy(F.col("conv_id").alias("case_id")).agg(items.alias("items"))


@query("SELECT conv_id AS case_id, count(*) AS tasks, count(*) AS mapped FROM conversations GROUP BY conv_id")
def k7_annotation_files(t):
    """Tasks and mapping of the annotation, written and read."""
    folder = scratch(t.spark)
    tables.write_annotation(*annotation.tasks(_cases(t), "case_id", "items"), folder)
    made = t.spark.read.json(f"{folder}/annotation_tasks").select("case_id", F.size("press_items").cast("long").alias("tasks"))
    return made.join(t.spark.read.json(f"{folder}/annotation_mapping").groupBy("case_id").agg(F.count("*").alias("mapped")), "case_id")


@query("SELECT source AS model, count(*) AS count, round(avg(doc_id % 11 + 1), 9) AS avg_rank, count(*) AS in_cases FROM documents GROUP BY source")
def k8_processed_files(t):
    """Processed annotations and metrics, written and read."""
    folder = scratch(t.spark)
    rows = t.documents.select(F.col("lang").alias("case_id"), F.concat(F.lit("pr"), "doc_id").alias("press_id"), F.col("source").alias("model_name"), (F.col("doc_id") % 11 + 1).alias("rank"), *[F.lit(False).alias(f) for f in annotation.FLAGS])
    tables.write_processed(annotation.by_case(rows), annotation.model_metrics(rows), folder)
    found = t.spark.read.json(f"{folder}/processed_results").select(F.explode("press_items").alias("i")).groupBy(F.col("i.model_name").alias("model")).agg(F.count("*").alias("in_cases"))
    return t.spark.read.json(f"{folder}/model_metrics").select("model", "count", F.round("avg_rank", 9).alias("avg_rank")).join(found, "model")


@query("""SELECT lang AS model, 'chars' AS metric, count(*) AS n, round(avg(n_chars), 6) AS mean, CAST(min(n_chars) AS DOUBLE) AS least, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, CAST(max(n_chars) AS DOUBLE) AS most FROM documents GROUP BY lang""")
def k9_figure_data(t):
    """What the figures of a report show."""
    rows = t.documents.select(F.col("lang").alias("model"), F.col("n_chars").alias("chars"), F.lit(None).cast("string").alias("error"))
    return evaluation.figure_data(rows, "model", ["chars"]).withColumn("mean", F.round("mean", 6))


@query("""WITH m AS (SELECT source AS model, avg(doc_id % 11 + 1) AS avg_rank FROM documents GROUP BY source)
SELECT row_number() OVER (ORDER BY avg_rank, model) AS place, model FROM m""")
def k10_markdown(t):
    """The places of the models in the ranking report, read from its lines."""
    metrics = t.documents.groupBy(F.col("source").alias("model")).agg(F.avg(F.col("doc_id") % 11 + 1).alias("avg_rank"))
    lines = [x.split(" | ") for x in evaluation.markdown_report(metrics).splitlines()[4:]]
    return t.spark.createDataFrame([(int(x[0].removeprefix("| ")), x[1]) for x in lines], "place long, model string")


@query("SELECT lang AS model, doc_id, n_chars AS chars FROM documents WHERE n_chars > 300 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 4")
def k11_examples_file(t):
    """The first four valid rows of each model through a CSV; columns without a value stay out."""
    path = f"{scratch(t.spark)}/examples.csv"
    rows = t.documents.select(F.col("lang").alias("model"), "doc_id", F.col("n_chars").alias("chars"), F.lit(None).cast("double").alias("bertscore_f1"), F.when(F.col("n_chars") <= 300, "short").alias("error"))
    tables.write_csv(evaluation.example_rows(rows, "model", "doc_id", k=4), path)
    return tables.read_csv(t.spark, path).withColumns({"doc_id": F.col("doc_id").cast("long"), "chars": F.col("chars").cast("long")})


@query("SELECT s AS split, count(*) AS n FROM documents, (SELECT unnest(['train', 'validation', 'test']) AS s) WHERE (s = 'train') = (doc_id % 10 <> 0) GROUP BY s")
def k13_split_files(t):
    """Training rows as JSON lines by split: without rows of its own, test is a copy of validation."""
    folder = scratch(t.spark)
    rows = t.documents.withColumn("split_name", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))
    tables.write_splits(prompts.training_rows(rows, "doc_id", "lang", "text", "source", split="split_name"), folder)
    return t.spark.read.json(folder).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, o_orderstatus AS state, o_custkey AS cust FROM orders WHERE o_orderkey % 4 <> 0")
def p10_fixed_format(t):
    """A file with records of a wrong number of fields, written anew without them."""
    line = F.concat_ws(",", "o_orderkey", F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), "o_custkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("more")))
    out = f"{scratch(t.spark)}/fixed.csv"
    prompts.fix_format(t.spark, _lines(t, "broken", line), out)
    return tables.read_csv(t.spark, out).select(F.col("id").cast("long"), "state", F.col("cust").cast("long"))


@query("""SELECT doc_id, 'Write about "' || lang || '",' || chr(10) || 'as asked ' || doc_id AS prompt, length(text) AS chars FROM documents WHERE doc_id % 4 <> 0""")
def p11_clean_prompts(t):
    """A file of prompts with quotes and breaks, whole texts beside them, cut by many tasks; each fourth prompt is an error and goes."""
    path = f"{scratch(t.spark)}/prompts.csv"
    prompt = F.when(F.col("doc_id") % 4 == 0, F.lit("API-Fehler: no answer")).otherwise(F.concat(F.lit('Write about "'), "lang", F.lit('",\nas asked '), "doc_id"))
    tables.write_csv(t.documents.select("doc_id", prompt.alias("synthetic_prompt"), "text"), path)
    made = prompts.clean_prompts(t.spark, path, "synthetic_prompt")
    return made.select(F.col("doc_id").cast("long"), F.col("synthetic_prompt").alias("prompt"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


@query("SELECT unnest(['Missing columns: date, synthetic_prompt']) AS message")
def p3_missing_columns(t):
    """What validation says of a table without two of its columns."""
    names = [c for c in cleaning.REQUIRED if c not in ("date", "synthetic_prompt")]
    sound, errors = cleaning.validate(t.documents.select(*[F.lit("x").alias(c) for c in names]))
    return t.spark.createDataFrame([(e,) for e in errors], "message string")


@query("SELECT doc_id, '' AS prompt, lang FROM documents")
def p4_filled(t):
    """Absent columns as empty text; those that are there stay."""
    return cleaning.fill_absent(t.documents.select("doc_id", "lang"), ["prompt", "lang"])


@query("SELECT CAST(count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS changed, count(*) AS filled FROM orders")
def p12_sanitized(t):
    """Wrapped answers of each third order; the number of changed and of filled ones."""
    answer = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Here is the prompt: ").otherwise(""), F.lit("Write about order "), "o_orderkey")
    return prompts.sanitized(t.orders.select("o_orderkey", answer.alias("p")), "p")[1]


@query("SELECT doc_id, lang, n_chars FROM documents")
def p21_ordered_columns(t):
    """Named columns first, all others after them."""
    df = prompts.ordered_columns(t.documents.select("n_chars", "lang", "doc_id"), ["doc_id", "none", "lang"])
    if df.columns != ["doc_id", "lang", "n_chars"]:
        raise ValueError(f"wrong order: {df.columns}")
    return df


_MOCK = "left(array_to_string(list_transform(range(0, 10), lambda i: sha256(doc_id || '/{0}/' || i)), ''), CAST(CAST('0x' || left(sha256(doc_id || '/{0}/'), 8) AS BIGINT) % 301 + 300 AS INT))"


@query(f"SELECT doc_id, {_MOCK.format('m1')} AS m1, 'kept' AS m2 FROM documents")
def t28_mock_columns(t):
    """Stand-in outputs of a model that the table lacks, of 300 to 600 characters; a column that is there stays."""
    return prompts.mock_columns(t.documents.select("doc_id", F.lit("kept").alias("m2")), "doc_id", ["m1", "m2"]).select("doc_id", "m1", "m2")


@query(f"SELECT doc_id, md5(text) AS text_md5, md5({_MOCK.format('m1')}) AS m1_md5 FROM documents WHERE doc_id % 6 <> 0")
def c12_mock_chain(t):
    """A broken file of documents, each sixth with a field too many, read by its records of the right length; stand-in columns added, written, and read again."""
    folder = scratch(t.spark)
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "doc_id", quoted, F.when(F.col("doc_id") % 6 == 0, F.lit("more")))
    broken = _lines(t, "broken.csv", line, t.documents, "doc_id,text")
    rows = prompts.mock_columns(tables.read_arity(t.spark, broken), "doc_id", ["m1"])
    tables.write_csv(rows, f"{folder}/mocked.csv")
    made = tables.read_arity(t.spark, f"{folder}/mocked.csv")
    return made.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.md5("m1").alias("m1_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'done ' || doc_id WHEN doc_id % 5 = 2 THEN NULL ELSE 'made' END AS state FROM documents".replace("doc_id % 5 < 2", "doc_id < 60 AND doc_id % 2 = 0").replace("doc_id % 5 = 2", "doc_id < 60"))
def c7_synthesize(t):
    """Prompts: those of an earlier run before row 60 are carried over (odd ones are missing there), all from 60 on are made."""
    rows = t.documents.select("doc_id", F.concat(F.lit("Urteil "), "text").alias("judgement"), F.lit("Presse").alias("summary"))
    done = t.documents.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("done "), "doc_id").alias("prompt"))
    made = prompts.synthesize(rows, "doc_id", "judgement", "summary", "prompt", ModelConfig("echo"), done, 60)
    return made.select("doc_id", F.when(F.col("prompt").startswith("done") | F.col("prompt").isNull(), F.col("prompt")).otherwise("made").alias("state"))


@query("SELECT lang AS name, CASE WHEN lang = 'en' THEN 3 ELSE 600 END AS max_chars FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def c13_model_configs(t):
    """Model records, one for each language, as configurations of known kinds, with their options or defaults."""
    from tarnwell.functions.adapters import build, configs

    names = [r.lang for r in t.documents.where("lang IS NOT NULL").select("lang").distinct().limit(1000).collect()]
    found = configs([{"name": n, "type": "local", "max_chars": 3} if n == "en" else {"name": n} for n in names])
    return t.spark.createDataFrame([(c.name, build(c).max_chars) for c in found], "name string, max_chars int")


@query("SELECT unnest(['run_10.csv', 'run_10_clean.csv', 'run_5.csv']) AS file, unnest(['backup', 'remove', 'keep']) AS action")
def c14_housekeeping(t):
    """What to do with checkpoint files: the newest is backed up, what was derived from it can go."""
    folder = scratch(t.spark)
    for name in ("run_5.csv", "run_10_clean.csv", "run_10.csv"):  # written in this order
        t.documents.select("doc_id", "text").write.csv(f"{folder}/{name}")
    found = tables.folder_table(t.spark, folder, "run_*.csv")
    return tables.housekeeping(found).select("file", "action")


@query("SELECT source AS model, avg(doc_id % 11 + 1) AS avg_rank, row_number() OVER (ORDER BY avg(doc_id % 11 + 1), source) AS place FROM documents GROUP BY source")
def l3_rank_ascending(t):
    """Models by average rank, the lowest first."""
    return evaluation.ranked(t.documents.groupBy(F.col("source").alias("model")).agg(F.avg(F.col("doc_id") % 11 + 1).alias("avg_rank")), "avg_rank", True)


@query("SELECT doc_id, md5('Pressemitteilung:' || chr(10) || CASE WHEN length(text) > 4000 THEN left(text, 4000) || '...' ELSE text END || chr(10) || chr(10) || 'Gerichtsurteil:' || chr(10) || CASE WHEN length(text) > 12000 THEN left(text, 12000) || '...' ELSE text END) AS request_md5 FROM documents")
def t3_request(t):
    """Requests for prompts, both texts within their limits."""
    return t.documents.select("doc_id", F.md5(prompts.request(F.col("text"), F.col("text"))).alias("request_md5"))


@query("SELECT doc_id, 'only' AS model, true AS same FROM documents")
def k4_results_appended(t):
    """Results by model, added in two runs; the second makes only what the first did not."""
    folder = scratch(t.spark)
    rows = t.documents.select("doc_id", F.col("text").alias("r"), F.lit("p").alias("p"))
    model = ModelConfig("only", options={"max_chars": 1 << 30})
    tables.append_results(generate(rows.where("doc_id % 2 = 0"), model, "doc_id", "r", "p"), folder)
    tables.append_results(generate(not_done(rows, t.spark.read.parquet(folder), "doc_id"), model, "doc_id", "r", "p"), folder)
    made = t.spark.read.parquet(folder).join(rows, "doc_id")
    return made.select("doc_id", "model", F.col("generated").endswith(F.col("r")).alias("same"))


@query("SELECT doc_id, (length(text) // 4 <= 128) AS short FROM documents WHERE length(text) > 0")
def s15_json_lines(t):
    """Training rows as JSON lines, read again."""
    path = f"{scratch(t.spark)}/train.jsonl"
    tables.write_jsonl(t.documents.select("doc_id", "text"), path)
    return tables.read_table(t.spark, path).where("length(text) > 0").select("doc_id", (text.tokens_estimate(F.col("text")) <= 128).alias("short"))


@query("""WITH v AS (SELECT doc_id, 'short' AS model, left(text, length(text) // 2) AS g, text AS r FROM documents UNION ALL SELECT doc_id, 'none', NULL, text FROM documents),
w AS (SELECT model, g, len(list_filter(regexp_split_to_array(g, '\\s+'), lambda x: x <> '')) AS a, len(list_filter(regexp_split_to_array(r, '\\s+'), lambda x: x <> '')) AS b FROM v)
SELECT model, count(*) AS total_samples, count(*) FILTER (g <> '') AS successful_generations, round(avg(CASE WHEN g <> '' THEN CASE WHEN a = 0 OR b = 0 THEN 0 ELSE least(a, b) / greatest(a, b) END END), 9) AS avg_length_ratio FROM w GROUP BY model
UNION ALL SELECT 'lost', NULL, NULL, NULL""")
def c5_resumed_run(t):
    """An evaluation of all documents, stopped after the first of its steps and called again with more models and other steps. Row numbers are null where the id is a multiple of 50."""
    folder = f"{scratch(t.spark)}/results"
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    wide = t.documents.select(F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")).alias("row"), F.col("text").alias("press"), half.alias("short"), F.lit(None).cast("string").alias("none"))
    third = t.documents.agg(F.max("doc_id")).first()[0] // 3 + 1
    evaluation.run(wide, "row", "press", ["short"], folder, third, stem=False, steps=1)
    found = evaluation.run(wide, "row", "press", ["short", "none", "lost"], folder, third + third // 2, stem=False)
    return found.select("model", "total_samples", "successful_generations", F.round("avg_length_ratio", 9).alias("avg_length_ratio"))


@query("SELECT (SELECT least(count(*), 30) FROM documents) AS rows_taken, true AS only_true_pairs")
def t29_sampled_pairs(t):
    """Near duplicates within a sample of thirty documents and their edited copies."""
    from tarnwell.operators.relations import near_duplicates

    first = t.documents.orderBy(F.xxhash64(F.col("doc_id"), F.lit(42)), "doc_id").limit(30).select("doc_id", F.substring("text", 1, 400).alias("text"))
    pairs = near_duplicates(t.documents.select("doc_id", F.substring("text", 1, 400).alias("text")), "doc_id", "text", 0.9, sample=30)
    known = first.select(F.col("doc_id").alias("key_a")).union(first.select("doc_id")).distinct()
    wrong = pairs.join(known, "key_a", "left_anti").count() + pairs.where("ratio <= 0.9").count()
    return first.agg(F.count("*").alias("rows_taken")).withColumn("only_true_pairs", F.lit(wrong == 0))
