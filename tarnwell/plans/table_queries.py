"""Queries over tables: joins, aggregates, windows, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.functions import metrics, text
from tarnwell.operators import cleaning, evaluation, ranking, relations, rolling, selection
from tarnwell.plans.registry import query


@query("SELECT upper(left(lower(o_orderstatus), 1)) || substr(lower(o_orderstatus), 2) AS subset_name, 'train' AS split_name, count(*) AS n FROM orders GROUP BY ALL")
def s1_union_tagged(t):
    parts = [(t.orders.where(F.col("o_orderstatus") == s), {"subset_name": s.upper(), "split_name": "train"}) for s in ("F", "O", "P")]
    return relations.union_tagged(parts).groupBy("subset_name", "split_name").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN quality = 0 THEN 'removed' ELSE 'cleaned' END AS status, lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def s2_split_status(t):
    both = t.documents.join(t.labels, "doc_id").withColumn("bad", F.col("quality") == 0)
    return cleaning.split_by_flag(both, "bad").groupBy("status", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents SEMI JOIN labels USING (doc_id)")
def s11_pruned_scan(t):
    return relations.only_in(t.documents.select("doc_id", "text"), t.labels, "doc_id")


@query("""WITH a AS (SELECT doc_id, min(CASE WHEN doc_id % 2 = 0 THEN quality END) AS score FROM labels GROUP BY 1), b AS (SELECT doc_id, min(quality) AS score, min(toxic) AS toxic FROM labels GROUP BY 1)
SELECT doc_id, coalesce(a.score, b.score) AS score, b.toxic FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def j1_coalesce_merge(t):
    a = t.labels.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality")).alias("score"))
    b = t.labels.select("doc_id", F.col("quality").alias("score"), "toxic")
    return relations.coalesce_merge(t.documents.select("doc_id"), [a, t.labels.select("doc_id"), b], "doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j2_semi(t):
    buyers = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return relations.only_in(t.customer.select("c_custkey", "c_name"), buyers, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j3_anti(t):
    return relations.missing_in(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH q AS (SELECT doc_id, max('q' || quality) AS s FROM labels GROUP BY 1), x AS (SELECT doc_id, max('t' || toxic) AS s FROM labels WHERE toxic = 1 GROUP BY 1)
SELECT doc_id, concat_ws(';', 'quality=' || q.s || '/full', 'toxic=' || x.s || '/hier') AS models FROM documents LEFT JOIN q USING (doc_id) LEFT JOIN x USING (doc_id)""")
def j4_nested(t):
    q = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("s"))
    x = t.labels.where("toxic = 1").select("doc_id", F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("s"))
    out = relations.nested(t.documents.select("doc_id"), "doc_id", [("quality", "full", q, "s"), ("toxic", "hier", x, "s")])
    return out.select("doc_id", F.array_join(F.transform("model_summaries", lambda m: F.concat(m["model_name"], F.lit("="), m["summary"], F.lit("/"), m["category"])), ";").alias("models"))


@query("SELECT o_orderkey, coalesce(n_name, 'UNKNOWN') AS n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def j5_lookup_default(t):
    named = t.customer.where("c_acctbal > 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return relations.lookup(t.orders.select("o_orderkey", "o_custkey"), named, ["o_custkey"], "n_name").select("o_orderkey", "n_name")


@query("SELECT o_orderkey, model FROM orders, (SELECT unnest(['a', 'b']) AS model) WHERE NOT (model = 'a' AND o_orderstatus = 'F')")
def j6_resume(t):
    done = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", F.lit("a").alias("model"))
    return relations.open_work(t.orders.select("o_orderkey"), ["a", "b"], done, "o_orderkey").select("o_orderkey", "model")


@query("SELECT o_orderkey, model, CAST(round(CASE model WHEN 'price' THEN o_totalprice ELSE o_custkey END * 100) AS BIGINT) AS generated FROM orders, (SELECT unnest(['price', 'cust']) AS model)")
def j7_models_rows(t):
    wide = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    return relations.unpivot_models(wide, ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "model", F.round(F.col("generated") * 100).cast("long").alias("generated"))


@query("SELECT a.o_orderkey, a.o_custkey, b.o_orderpriority FROM orders a JOIN orders b USING (o_orderkey)")
def j10_by_position(t):
    return relations.by_position(t.orders.select("o_orderkey", "o_custkey"), t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'old' END AS v FROM orders")
def u3_override(t):
    old = t.orders.select("o_orderkey", F.lit("old").alias("v"))
    new = t.orders.where(F.col("o_orderstatus") == "O").select("o_orderkey", F.lit("new").alias("v"))
    return relations.override(old, new, ["o_orderkey"])


@query("SELECT DISTINCT lang, source FROM documents")
def u5_distinct(t):
    return t.documents.select("lang", "source").distinct()


@query("SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def a1_counts(t):
    return t.documents.where("lang IS NOT NULL AND source IS NOT NULL").groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM documents GROUP BY lang")
def a2_split_pct(t):
    from pyspark.sql import Window

    counts = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))  # a row for each language


@query("SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS std FROM documents GROUP BY source")
def a3_group_stats(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean"), F.round(F.stddev_samp(F.length("text")), 6).alias("std"))


@query("SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS most FROM documents")
def a4_describe(t):
    out = t.documents.agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("std"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    return out.crossJoin(selection.quantiles(t.documents, "n_chars", {"q25": 0.25, "q50": 0.5, "q75": 0.75}))  # one row each


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL")
def a5_per_year(t):
    return t.orders.select(F.regexp_extract(F.col("o_orderdate").cast("string"), r"(\d{4})", 1).cast("long").alias("year")).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT event_type AS model, count(*) AS total, count(*) FILTER (user_id % 3 = 0) AS errors, (count(*) - count(*) FILTER (user_id % 3 = 0)) * 100 / count(*) AS success_percent FROM events GROUP BY ALL")
def a9_success(t):
    from tarnwell.operators.evaluation import success_rates

    return success_rates(t.events.withColumn("error", F.when(F.col("user_id") % 3 == 0, "failed")), "event_type", "error").withColumnRenamed("event_type", "model")


@query("SELECT lang, count(length(text)) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, median(length(text)) AS median FROM documents GROUP BY lang")
def a15_len_stats(t):
    rows, x = t.documents.select("lang", F.length("text").alias("x")), F.col("x")
    out = rows.groupBy("lang").agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 6).alias("mean"))
    middle = selection.quantiles(rows, "x", {"median": 0.5}, ["lang"]).withColumnRenamed("lang", "_lang")
    return out.join(middle, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")


@query("SELECT source, count(*) AS n, count(CASE WHEN n_chars > 500 THEN text END) AS filled, count(CASE WHEN n_chars > 500 THEN text END) * 100 / count(*) AS percent FROM documents GROUP BY source")
def a16_growth(t):
    done = F.count(F.when(F.col("n_chars") > 500, F.col("text")))
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), done.alias("filled"), (done * 100 / F.count("*")).alias("percent"))


@query("SELECT lang, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum(length(text) // 4) * 0.000003, 9) AS cost FROM documents GROUP BY lang")
def a17_cost(t):
    n = F.sum(text.tokens_estimate(F.col("text")))
    return t.documents.groupBy("lang").agg(n.alias("tokens"), F.round(n * 0.000003, 9).alias("cost"))


@query(" UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER (contains(lower(text), '{p}')) * 100 / count(*) AS percent FROM documents HAVING count(*) FILTER (contains(lower(text), '{p}')) > 0" for p in ("licensed", "copyright", "idiot", "zusammenfassen")))
def a18_phrase_share(t):
    phrases = ["licensed", "copyright", "idiot", "zusammenfassen"]
    row = t.documents.agg(F.count("*").alias("n"), *[F.sum(F.lower("text").contains(p).cast("long")).alias(f"v{i}") for i, p in enumerate(phrases)])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"v{i}").alias("v")) for i, p in enumerate(phrases)])).alias("c")).where("c.v > 0").select("c.phrase", (F.col("c.v") * 100 / F.col("n")).alias("percent"))


@query("SELECT count(text) - count(DISTINCT text) AS repeated, (count(text) - count(DISTINCT text)) * 100 / count(text) AS percent FROM documents")
def a19_dups(t):
    # hash the texts by group first: equal texts meet as one row each
    by = t.documents.where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n"))
    out = by.agg((F.sum("n") - F.count("*")).alias("repeated"), F.sum("n").alias("total"))
    return out.select("repeated", (F.col("repeated") * 100 / F.col("total")).alias("percent"))


@query("""WITH b AS (SELECT least(floor(l_quantity / 10), 5) AS bin FROM lineitem) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY ALL""")
def a21_histogram(t):
    return t.lineitem.select(F.least(F.floor(F.col("l_quantity") / 10), F.lit(5)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_returnflag AS m, count(*) AS n, avg(l_extendedprice) AS mean, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT a.m AS model_a, b.m AS model_b, round(CASE WHEN a.m = b.m THEN 0.0 ELSE (a.mean - b.mean) / sqrt(a.v / a.n + b.v / b.n) END, 6) AS t,
  round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 3) AS df FROM s a, s b""")
def a22_welch(t):
    return metrics.welch(t.lineitem, "l_returnflag", "l_extendedprice").select("model_a", "model_b", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query()
def a22_welch_p(t):
    found = metrics.welch(t.lineitem, "l_returnflag", "l_extendedprice")
    return found.select("model_a", "model_b", metrics.t_p_value("t", "df").alias("p"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1)")
def w1_latest(t):
    return relations.latest(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations")
def w2_rank_pos(t):
    listed = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.posexplode("turns").alias("pos", "turn")).select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("rank"))


@query("SELECT c_mktsegment, least(count(*), 20) AS n FROM customer GROUP BY ALL")
def w3_stratified(t):
    return ranking.stratified(t.customer, "c_mktsegment", "c_custkey", 20).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(ts) AS ts FROM events GROUP BY 1), c AS (SELECT day, ts, sum(n) OVER (ORDER BY day) AS n FROM d),
l AS (SELECT day, n, epoch(ts) - epoch(lag(ts) OVER (ORDER BY day)) AS seconds, n - lag(n) OVER (ORDER BY day) AS added FROM c)
SELECT day, CAST(n AS BIGINT) AS n, round(seconds, 3) AS seconds, CAST(added AS BIGINT) AS added, round(CASE WHEN seconds > 0 THEN added / seconds * 3600 END, 6) AS per_hour FROM l""")
def w4_lag_rate(t):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("added_rows"), F.max("ts").alias("ts"))
    grown = rolling.running(days, ["day"], {"n": F.col("added_rows")})
    return rolling.deltas(grown, "day", "ts", "n").select("day", "n", F.round("seconds", 3).alias("seconds"), "added", F.round("per_hour", 6).alias("per_hour"))


@query("""WITH l AS (SELECT lang, doc_id AS id, unnest(['chars', 'words']) AS metric, unnest([n_chars, CAST(len(string_split(text, ' ')) AS BIGINT)]) AS value FROM documents)
SELECT lang, metric, id, value FROM l QUALIFY row_number() OVER (PARTITION BY lang, metric ORDER BY value DESC, id) = 1""")
def w5_argmax(t):
    rows = t.documents.select("lang", F.col("doc_id").alias("id"), F.col("n_chars").alias("chars"), F.size(F.split("text", " ")).cast("long").alias("words"))
    return ranking.best_of(rows, ["lang"], ["chars", "words"], "id")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, c_custkey) - 1 AS row_id FROM customer")
def w6_ordered(t):
    """A contiguous row number in a fixed order of segments."""
    order = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return cleaning.row_ids(t.customer.select("c_custkey", "c_mktsegment", order.alias("o")), ["o", F.asc_nulls_last("c_custkey")], "row_id").drop("o")


@query("""SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 6) AS tokens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""")
def w9_usage_window(t):
    return rolling.usage(t.events, "ts", {"tokens": "value"}, "event_type").select("event_id", "requests", F.round("tokens", 6).alias("tokens"))


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS sec, coalesce(value, 0) AS n FROM events),
w AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS total FROM e),
p AS (SELECT w.event_id, w.total, x.sec, sum(x.n) OVER (PARTITION BY w.event_id ORDER BY x.sec) AS s FROM w JOIN e x ON x.event_type = w.event_type AND x.sec BETWEEN w.sec - 600000000 AND w.sec WHERE w.total > 30),
f AS (SELECT event_id, min(sec) FILTER (round(s, 9) >= round(total - 30, 9)) AS first FROM p GROUP BY ALL)
SELECT event_id, round(CASE WHEN total > 30 THEN greatest(first + 600000000 - sec, 0) / 1e6 ELSE 0 END, 6) AS wait_seconds FROM w LEFT JOIN f USING (event_id)""")
def w10_wait(t):
    return rolling.waits(t.events.select("event_id", "ts", "value", "event_type"), "ts", "value", 30, "event_type", 600).select("event_id", F.round("wait_seconds", 6).alias("wait_seconds"))


@query("SELECT click_id, count(*) OVER w AS requests, round(sum(value) OVER w, 6) AS tokens FROM clicks WHERE ts IS NOT NULL WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)")
def w9_shared_budget(t):
    """All clicks as calls on one budget: there is no group to deal them out by, and times, clients and values may be null or repeated."""
    return rolling.usage(t.clicks.where("ts IS NOT NULL"), "ts", {"tokens": "value"}).select("click_id", "requests", F.round("tokens", 6).alias("tokens"))


@query("SELECT sale_id, status, round(sum(total) OVER (PARTITION BY status ORDER BY sold_at, sale_id RANGE UNBOUNDED PRECEDING), 3) AS so_far, lag(total) OVER (PARTITION BY status ORDER BY sold_at, sale_id, total) AS before FROM (SELECT sale_id, status, total, sold_at FROM sales WHERE sold_at IS NOT NULL GROUP BY ALL HAVING count(*) = 1)")
def w4_running(t):
    """The running total of sales by status and the sale before; a status may hold a third of all rows."""
    rows = t.sales.where("sold_at IS NOT NULL").groupBy("sale_id", "status", "total", "sold_at").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    out = rolling.previous(rolling.running(rows, ["sold_at", "sale_id"], {"so_far": F.col("total")}, "status"), ["sold_at", "sale_id", "total"], {"before": "total"}, "status")
    return out.select("sale_id", "status", F.round("so_far", 3).alias("so_far"), "before")


@query(f"SELECT unnest([{', '.join(repr(m) for m in evaluation.metric_order(evaluation.METRICS))}]) AS metric, unnest(range(1, {len(evaluation.METRICS)} + 1)) AS place")
def w7_metric_order(t):
    """The listed metrics in the order of result tables, worked out from their names in any order."""
    names = evaluation.metric_order(sorted(evaluation.METRICS, reverse=True))
    return t.spark.createDataFrame([(m, i) for i, m in enumerate(names, 1)], "metric string, place long")


_TOP = "SELECT o_custkey, o_orderkey, rank, {1} AS kind FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice {0}, o_orderkey) AS rank FROM orders) WHERE rank <= 3"


@query(f"{_TOP.format('DESC', chr(39) + 'best' + chr(39))} UNION ALL {_TOP.format('ASC', chr(39) + 'worst' + chr(39))}")
def l1_topk(t):
    from tarnwell.operators.evaluation import examples

    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice").withColumn("error", F.lit(None).cast("string"))
    return examples(rows, "o_custkey", "o_totalprice", "o_orderkey", 3).select("o_custkey", "o_orderkey", "rank", "kind")


@query("SELECT source AS model, avg(quality) AS score, row_number() OVER (ORDER BY avg(quality) DESC, source) AS place FROM labels JOIN documents USING (doc_id) GROUP BY source")
def l2_ranking(t):
    from tarnwell.operators.evaluation import ranked

    return ranked(t.labels.join(t.documents, "doc_id").groupBy(F.col("source").alias("model")).agg(F.avg("quality").alias("score")), "score")


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5")
def l4_first_k(t):
    return ranking.first_rows(t.documents.select("source", "doc_id"), "source", "doc_id", 5)


@query("SELECT * FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)")
def l5_head(t):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("SELECT * FROM (SELECT doc_id, n_chars FROM documents ORDER BY doc_id DESC LIMIT 5)")
def l5_tail(t):
    """The last rows of an order, as the first of the reverse: each task keeps its own best before they meet."""
    return ranking.tail(t.documents.select("doc_id", "n_chars"), ["doc_id"], 5)


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) AS sound FROM (SELECT doc_id FROM documents LIMIT 25)")
def l5_sample(t):
    """A random sample of rows for display, the same for a seed: how many, how many different, and how many of them are the table's rows."""
    shown = ranking.sample_rows(t.documents.select("doc_id", "n_chars"), "doc_id", 25, 7)
    real = shown.join(t.documents.select("doc_id", F.col("n_chars").alias("own")), "doc_id").where("own = n_chars")
    return real.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.sum((F.col("own") == F.col("n_chars")).cast("long")).alias("sound"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id = 7")
def l6_row(t):
    return t.documents.where("doc_id = 7").select("doc_id", "lang")


@query()
def l7_split(t):
    """Exactly nine tenths of the documents, by a hash, are training rows."""
    return selection.exact_split(t.documents.select("doc_id"), "doc_id", 0.9)


@query("WITH c AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.9) AS BIGINT) AS k FROM sale_lines) SELECT 'train' AS split, k AS n FROM c UNION ALL SELECT 'validation', n - k FROM c")
def l7_counts(t):
    """As many training rows as asked for, though keys are null or repeated, and one may have a third of all rows."""
    return selection.exact_split(t.sale_lines.select("sale_id"), "sale_id", 0.9).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT nation_id, count(balance) AS n, quantile_cont(balance, 0.1) AS q10, median(balance) AS q50, quantile_cont(balance, 0.9) AS q90 FROM clients GROUP BY nation_id")
def a4_quantiles(t):
    """Exact quantiles of doubles by nation; a nation may be null or have a third of all rows."""
    found = selection.quantiles(t.clients, "balance", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, ["nation_id"]).withColumnRenamed("nation_id", "_nation")
    counts = t.clients.groupBy("nation_id").agg(F.count("balance").alias("n"))
    return counts.join(found, F.col("nation_id").eqNullSafe(F.col("_nation"))).drop("_nation")


@query("SELECT o_orderkey, o_orderkey // CAST(ceil((SELECT count(*) FROM orders) / 4) AS BIGINT) AS part FROM orders")
def l8_ranges(t):
    return t.orders.select("o_orderkey", ranking.contiguous(F.col("o_orderkey"), t.orders.count(), 4).alias("part"))
