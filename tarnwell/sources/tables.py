"""Reading and writing of CSV, JSON, JSON lines and Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.text import checkpoint_number
from tarnwell.operators.relations import union_tagged
from tarnwell.sources.json_lists import json_lines
from tarnwell.sources.quoted import records
from tarnwell.sources.scratch import settled

#: Cells that count as missing on reading.
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Endings of files that were derived from a checkpoint.
DERIVED = ["_clean", "_fixed", "_repaired", "_original", "_sanitized"]
#: Every cell quoted, with the white space at its ends, which Spark's writer takes away by itself.
WRITTEN = {"header": "true", "quoteAll": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "encoding": "UTF-8"}


def missing_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(NA_STRINGS), F.col(c)) for c, kind in df.dtypes if kind == "string"})


def read_csv(spark: SparkSession, path: str | list[str], na: bool = True, backslash: bool = False, **options) -> DataFrame:
    """All columns as text; cells that mean nothing as null. backslash: doubled ones are one."""
    df = spark.read.options(**(CSV | options)).csv(path)
    if backslash:
        df = df.withColumns({c: F.replace(F.col(c), F.lit("\\\\"), F.lit("\\")) for c in df.columns})
    return missing_to_null(df) if na else df


def header_of(spark: SparkSession, path: str, **options) -> list[str]:
    """The column names alone; no row is read."""
    return spark.read.options(**(CSV | options)).csv(path).columns


def _as_columns(found: DataFrame, names: list[str]) -> DataFrame:
    """Records as rows of named text columns, headers left out, missing fields null."""
    field = lambda i: F.try_element_at("fields", F.lit(i + 1))
    return missing_to_null(found.where(~F.col("first")).select(*[field(i).alias(c) for i, c in enumerate(names)]))


def read_tolerant(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """Rows with too many fields go; rows with too few are filled up with null, or go too if exact."""
    names = header_of(spark, path)
    found = records(spark, path)
    return _as_columns(found.where(F.size("fields") == len(names) if exact else F.size("fields") <= len(names)), names)


def read_table(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """CSV, JSON (a list of records), JSON lines or Parquet, by suffix."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        df = read_csv(spark, path)
    elif suffix == ".json":
        df = spark.read.json(json_lines(spark, path))
    elif suffix == ".jsonl":
        df = spark.read.json(path)
    elif suffix == ".parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"Unsupported format: {suffix or path}")
    return df if limit is None else df.limit(limit)


def read_plain(spark: SparkSession, path: str, limit: int | None = 5000) -> DataFrame:
    """The first rows of a CSV whose quotes are plain characters: every comma and line break counts."""
    df = missing_to_null(spark.read.options(**(CSV | {"quote": "", "multiLine": "false"})).csv(path))
    return df if limit is None else df.limit(limit)


def read_arity(spark: SparkSession, path: str) -> DataFrame:
    """Records that have as many fields as the header, all others go: the last resort for broken files.

    Records are cut exactly, whatever stands in their quotes, by many tasks a file.
    """
    return read_tolerant(spark, path, True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number and line of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("number"), F.col("value").alias("line"))


def read_split_status(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or a folder with cleaned.csv and removed.csv as one table with their status."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path)
    return union_tagged([(read_csv(spark, f"{path}/{s}.csv"), {"status": s}) for s in ("cleaned", "removed")])


def read_parts(spark: SparkSession, parts: list[tuple[str, str, str]]) -> tuple[DataFrame, list[str]]:
    """Tables of (subset, split, path) as one with both tags; and what could not be read."""
    tables, failed = [], []
    for subset, split, path in parts:
        try:
            tables.append((read_table(spark, path), {"subset_name": subset[:1].upper() + subset[1:], "split_name": split}))
        except Exception as error:  # one part less is better than none
            failed.append(f"{subset}/{split}: {type(error).__name__}")
    if not tables:
        raise ValueError("no part could be read: " + "; ".join(failed))
    return union_tagged(tables), failed


def read_glob(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All matching CSV files, and folders of part files, as one table with the file (or folder) of each row."""
    df = spark.read.options(**CSV).csv(f"{folder.rstrip('/')}/{pattern}")
    # every row has its path: cut at slashes, as a pattern would be tried at each of its characters
    path = F.col("_metadata.file_path")
    name = F.substring_index(path, "/", -1)
    return missing_to_null(df).withColumn("file", F.when(name.startswith("part-") & (name != "part-"), F.substring_index(F.substring_index(path, "/", -2), "/", 1)).otherwise(name))


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """The rows of the checkpoint file with the greatest number in its name. Numbers are looked for once a name, not once a row."""
    names = files.select("file").distinct().select("file", checkpoint_number(F.col("file")).alias("_n"))
    names = names.groupBy("_n").agg(F.collect_set("file").alias("_files")).where(F.col("_n").isNotNull())
    top = names.agg(F.max_by("_files", "_n").alias("_files"))  # one row, the names with the greatest number
    return files.join(F.broadcast(top.select(F.explode("_files").alias("file"))), "file", "left_semi").select(*files.columns)


def checkpoint_ends(total: int, batch: int, interval: int = 1, start: int = 0) -> list[int]:
    """Rows done at each checkpoint of a run: after each interval batches, and at its end."""
    ends = [min(b + batch, total) for b in range(start, total, batch)]
    return [e for i, e in enumerate(ends, 1) if i % interval == 0 or e == total]


def checkpoint_names(prefix: str, total: int, batch: int, interval: int = 1, start: int = 0) -> list[str]:
    """Names of the checkpoints that a run writes."""
    return [f"{prefix}_{e}.csv" for e in checkpoint_ends(total, batch, interval, start)]


def run_in_steps(rows: DataFrame, row_id: str, ends: list[int], step: Callable[[DataFrame], DataFrame], folder: str, prefix: str = "checkpoint") -> DataFrame:
    """step over the rows, written a checkpoint at a time as prefix_<end>.csv; what is there already is not run again.

    A checkpoint holds the rows from the one before it up to its end, so that each row is
    written once; together they are the table. Rows without a number, below 0 or from the last
    end on would be in none and are an error. A stopped run goes on at its first missing
    checkpoint: a folder counts when its writer has left its mark.
    """
    spark, first = rows.sparkSession, 0
    paths = [f"{folder}/{prefix}_{e}.csv" for e in ends]
    inside = (F.col(row_id) >= 0) & (F.col(row_id) < (ends[-1] if ends else 0))
    if outside := rows.where(~F.coalesce(inside, F.lit(False))).count():
        raise ValueError(f"{outside} rows are in no step")
    for end, path in zip(ends, paths):
        if not path_exists(spark, f"{path}/_SUCCESS"):
            write_csv(step(rows.where((F.col(row_id) >= first) & (F.col(row_id) < end))), path, backslash=True)
        first = end
    if not paths:
        return step(rows.limit(0))
    return read_csv(spark, paths, backslash=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder with all that is in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, none if it isn't there."""
    if not path_exists(spark, path):
        return []
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(f.getPath().toString() for f in found if f.isDirectory())


def file_table(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """file, bytes, modified, number (of the checkpoint) and derivative (a name with an added ending) of the matching files, contents unread."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.col("_metadata.file_name")
    return found.select(name.alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), checkpoint_number(name).alias("number"), name.rlike("(" + "|".join(DERIVED) + r")").alias("derivative"))


def folder_table(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """As file_table, for checkpoints that are folders of part files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder.rstrip('/')}/{pattern}")
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)/part-[^/]+$", 1)
    own = found.select(name.alias("file"), "length", "modificationTime").groupBy("file").agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    return own.select("file", "bytes", "modified", checkpoint_number(F.col("file")).alias("number"), F.col("file").rlike("(" + "|".join(DERIVED) + ")").alias("derivative"))


def housekeeping(files: DataFrame) -> DataFrame:
    """file, bytes and action: backup for the newest checkpoint, remove for what was derived from it, keep for all others. Nothing is deleted."""
    newest = files.where(~F.col("derivative")).agg(F.max_by("file", F.struct("modified", "file")).alias("newest"))
    stem = F.regexp_replace("newest", r"\.csv$", "")
    action = F.when(F.col("file") == F.col("newest"), "backup").when(F.col("file").startswith(F.concat(stem, F.lit("_"))), "remove").otherwise("keep")
    return files.crossJoin(F.broadcast(newest)).select("file", "bytes", action.alias("action"))  # one row


def merge_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of all JSON lists as one table; a file that holds no list of records is skipped."""
    return spark.read.json(json_lines(spark, paths))


def merge_json_into(spark: SparkSession, paths: list[str], path: str) -> None:
    """The records of all JSON lists as JSON lines."""
    write_jsonl(merge_json(spark, paths), path)


def evaluation_details(spark: SparkSession, folder: str, pattern: str = "*_results.json") -> DataFrame:
    """model, row_id, metric and value (text) of all files {summary, detailed_results: {row: {metric: value}}}."""
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(folder).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"_results\.json$", "").alias("model"))
    rows = texts.select("model", F.explode(F.from_json("value", "detailed_results map<string,map<string,string>>")["detailed_results"]).alias("row_id", "metrics"))
    return rows.select("model", "row_id", F.explode("metrics").alias("metric", "value"))


def write_evaluation(scored: DataFrame, summarize: Callable[[DataFrame], DataFrame], folder: str, row_id: str) -> None:
    """Scored rows by model, as a run resumes from them, and what summarize makes of them as one JSON line a model.

    The summary is made of the written rows, so nothing is scored twice.
    """
    scored.withColumn("row_id", F.col(row_id).cast("string")).write.mode("overwrite").partitionBy("model").parquet(f"{folder}/details")
    summarize(scored.sparkSession.read.parquet(f"{folder}/details")).write.mode("overwrite").json(f"{folder}/summary")


def load_evaluation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Summary and scored rows of a folder that write_evaluation made."""
    return spark.read.json(f"{folder}/summary"), spark.read.parquet(f"{folder}/details")


def summaries_long(spark: SparkSession, folder: str, pattern: str = "evaluation_summary*.json") -> DataFrame:
    """model, eval_type, metric, value of all summary files {model: {avg_metric: value}}."""
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    models = texts.select("file", F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("model", "metrics"))
    long = models.select(F.col("model"), F.when(F.col("file").contains("hier"), "hier").otherwise("full").alias("eval_type"), F.explode("metrics").alias("metric", "value"))
    return long.withColumn("metric", F.regexp_replace("metric", "^avg_", ""))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", backslash: bool = False) -> None:
    """Every cell quoted, quotes doubled; with backslash, backslashes are doubled as well."""
    if backslash:
        df = df.withColumns({c: F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")) for c, kind in df.dtypes if kind == "string"})
    df.write.mode(mode).options(**WRITTEN).csv(path)


def write_by(df: DataFrame, path: str, column: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """One folder for each value of the column: status, model or split."""
    writer = df.write.mode(mode).partitionBy(column)
    writer.options(**WRITTEN).csv(path) if kind == "csv" else writer.format(kind).save(path)


def append_results(df: DataFrame, path: str) -> None:
    """Results by model, added to those that are there; a run resumes by what they hold."""
    df.write.mode("append").partitionBy("model").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", test: str | None = "test", like: str = "validation") -> None:
    """JSON lines in one folder for each split that has rows; where no row is of the split `test`, it is a copy of the split `like`."""
    if test is not None and not df.where(F.col(split) == test).take(1):
        df = df.unionByName(df.where(F.col(split) == like).withColumn(split, F.lit(test)))
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_generation(results: DataFrame, folder: str) -> None:
    """Generated rows as CSV: one folder for each model, and all of them in all_models_results. Rows are generated once for both."""
    results = settled(results)
    write_by(results, f"{folder}/by_model", "model", "csv")
    write_csv(results, f"{folder}/all_models_results")


def write_annotation(tasks: DataFrame, mapping: DataFrame, folder: str) -> None:
    """Annotation tasks and the mapping of their press ids to models."""
    write_jsonl(tasks, f"{folder}/annotation_tasks")
    write_jsonl(mapping, f"{folder}/annotation_mapping")


def write_processed(cases: DataFrame, metrics: DataFrame, folder: str) -> None:
    """Processed annotations by case, and the metrics by model."""
    write_jsonl(cases, f"{folder}/processed_results")
    write_jsonl(metrics, f"{folder}/model_metrics")


def save_json(rows: DataFrame, path: str) -> None:
    """A table as one JSON list, written by many tasks: its part files, one after the other by name (`cat */part-*`), are the list.

    The first record opens it in a part of its own, all others bring their comma along, and the
    last part closes it. `read_table` and `merge_json` read the folder.
    """
    lines = settled(rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), F.monotonically_increasing_id().alias("_m")))
    first = lines.agg(F.min("_m")).first()[0]
    mark = lambda text: rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    led = lambda sign: F.concat(F.lit(sign), "value").alias("value")
    parts = [mark("["), None, mark("]")] if first is None else [lines.where(F.col("_m") == first).select(led("[")), lines.where(F.col("_m") != first).select(led(",")), mark("]")]
    delete(rows.sparkSession, path)
    for k, part in enumerate(parts):
        if part is not None:
            part.write.text(f"{path}/{k}")
