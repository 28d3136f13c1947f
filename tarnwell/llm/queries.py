"""The registered queries of the corpus operators; each works on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import bpe, branch_merge, decontam, fim, html_text, langid, ngram_join, quality, rules, sa_dedup, toxicity, urls, warc
from tarnwell.llm.common import fold, read

#: The vocabulary file of the BPE operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES: list[urls.Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = quality.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = quality.score(docs, trees)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs, fold("doc_id", 5) != 0))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, read(spark, sf_dir, "labels")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), TOKENIZER)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa_dedup.digest(read(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(read(spark, sf_dir, "documents")))


def op12_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch_merge.digest(branch_merge.merge_coded(read(spark, sf_dir, "documents")))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def queries() -> dict:
    made = [op1_quality, op2_langid, op3_ngram_join, op4_rules, op5_urls, op6_toxicity, op7_warc, op8_decontam, op9_bpe, op10_suffix_dedup, op11_fim, op12_branch_merge, op13_html_text]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": OP3, "op5_urls": OP5, "op7_warc": OP7, "op8_decontam": OP8, "op10_suffix_dedup": OP10, "op11_fim": OP11, "op12_branch_merge": OP12}


_MARK = "'<P>'", "'<S>'", "'<M>'"
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR {" OR ".join(f"contains(t, {m})" for m in _MARK)} OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, left(t, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

#: CRC-32 by its table of 256 remainders, worked out here.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 17"
_COLUMN = "CASE {1} WHEN 0 THEN '' WHEN 1 THEN {0} || '!' WHEN 2 THEN {0} || '?' ELSE {0} END"
_PIECE = "CASE {1} WHEN 1 THEN x || '!' WHEN 2 THEN x || '?' WHEN 0 THEN NULL ELSE x END"
_GAP = "CASE {0} WHEN 3 THEN '!' WHEN 4 THEN '?' END"
_TEXT = "coalesce(string_agg(CASE WHEN {0} IS NULL THEN {1} WHEN {1} IS NULL THEN {0} ELSE {0} || chr(10) || {1} END, chr(10) ORDER BY i), '')"
_CODED = ", ".join(f"max(CASE WHEN name = '{c}' THEN {b} END) AS {c}_{b}" for c in ("row", "lang", "source") for b in "lr")
_CHANGED = [f"{c}_l_v <> {c} AND {c}_r_v <> {c} AND {c}_l_v <> {c}_r_v" for c in ("lang", "source")]
_MOVED = [f"({c}_l_v <> {c} OR {c}_r_v <> {c})" for c in ("lang", "source")]
OP12 = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS q(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
lines AS (SELECT r, id, CAST(i - 1 AS VARCHAR) AS name, i, w[i] AS x FROM (SELECT r, id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, id, string_split(text, chr(10)) AS w FROM d))),
names AS (SELECT r, id, name FROM lines UNION ALL SELECT r, id, unnest(['row', 'lang', 'source']) FROM d),
codes AS (SELECT r, name, {_CRC.format("'L:' || id || ':' || name")} AS l, {_CRC.format("'R:' || id || ':' || name")} AS r_ FROM names, tab),
own AS (SELECT r, {_CODED.replace("THEN r ", "THEN r_ ")} FROM codes GROUP BY r),
pairs AS (SELECT r, i, x, l, r_, l < 3 AS el, r_ < 3 AS er, l IN (3, 4) AS gl, r_ IN (3, 4) AS gr, CASE WHEN l < 3 THEN l ELSE r_ END AS k, CASE WHEN l IN (3, 4) THEN l ELSE r_ END AS g FROM lines JOIN codes USING (r, name)),
cut AS (SELECT *, {_PIECE.format("", "k")} AS p, {_GAP.format("g")} AS q, {_PIECE.format("", "l")} AS pl, {_GAP.format("l")} AS ql FROM pairs),
text AS (SELECT r, {_TEXT.format("p", "q")} AS merged, {_TEXT.format("pl", "ql")} AS ltext, bool_or(l < 5) AS touched_l, bool_or(r_ < 5) AS touched_r,
         sum(((el OR er) AND NOT (el AND er AND l <> r_))::INT + ((gl OR gr) AND NOT (gl AND gr AND l <> r_))::INT) AS clean,
         sum((el AND er AND l <> r_ AND l > 0 AND r_ > 0)::INT) AS ee, sum((el AND er AND l <> r_ AND (l = 0 OR r_ = 0))::INT) AS ed, sum((gl AND gr AND l <> r_)::INT) AS ii FROM cut GROUP BY r),
v AS (SELECT *, {", ".join(_COLUMN.format(c, f"{c}_{b}") + f" AS {c}_{b}_v" for c in ("lang", "source") for b in "lr")} FROM d JOIN own USING (r) JOIN text USING (r)),
w AS (SELECT *, CASE WHEN row_l = 0 AND row_r = 0 THEN 'both' WHEN row_l = 0 THEN CASE WHEN touched_r OR lang_r_v <> lang OR source_r_v <> source THEN 'conflict' ELSE 'clean' END
      WHEN row_r = 0 THEN CASE WHEN touched_l OR lang_l_v <> lang OR source_l_v <> source THEN 'left' ELSE 'clean' END ELSE 'kept' END AS fate FROM v),
base AS (SELECT doc_id, {", ".join(f"CASE fate WHEN 'kept' THEN CASE WHEN {c}_l_v <> {c} THEN {c}_l_v ELSE {c}_r_v END WHEN 'left' THEN {c}_l_v END AS {c}" for c in ("lang", "source"))},
         sha256(CASE fate WHEN 'kept' THEN merged WHEN 'left' THEN ltext END) AS text_sha256,
         CASE WHEN fate = 'kept' THEN clean + ({_MOVED[0]} AND NOT ({_CHANGED[0]}))::INT + ({_MOVED[1]} AND NOT ({_CHANGED[1]}))::INT ELSE (fate IN ('both', 'clean'))::INT END AS n_clean,
         CASE WHEN fate = 'kept' THEN ee + ({_CHANGED[0]})::INT + ({_CHANGED[1]})::INT ELSE 0 END AS n_edit_edit,
         CASE WHEN fate = 'kept' THEN ed ELSE (fate IN ('conflict', 'left'))::INT END AS n_edit_delete, CASE WHEN fate = 'kept' THEN ii ELSE 0 END AS n_insert_insert FROM w),
added AS (SELECT -1 - doc_id AS doc_id, 1 AS side, lang, source, {_GAP.format("row_l")} AS mark FROM v WHERE row_l IN (3, 4) UNION ALL SELECT -5 - doc_id, 2, lang, source, {_GAP.format("row_r")} FROM v WHERE row_r IN (3, 4)),
whole AS (SELECT doc_id, min((lang, source, mark)) FILTER (side = 1) AS l, min((lang, source, mark)) FILTER (side = 2) AS r FROM added GROUP BY doc_id),
pick AS (SELECT doc_id, coalesce(l, r) AS x, l IS NOT NULL AND r IS NOT NULL AND l <> r AS clash FROM whole)
SELECT doc_id, lang, source, text_sha256, CAST(n_clean AS BIGINT) AS n_clean, CAST(n_edit_edit AS BIGINT) AS n_edit_edit, CAST(n_edit_delete AS BIGINT) AS n_edit_delete, CAST(n_insert_insert AS BIGINT) AS n_insert_insert FROM base
UNION ALL SELECT doc_id, x[1], x[2], sha256(x[3]), (NOT clash)::BIGINT, 0, 0, clash::BIGINT FROM pick
"""


#: Bytes as hexadecimal digits; windows are cut from blocks of 200 starts, so that no long text is walked for each of them.
OP10 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
b AS (SELECT r, n, b, substr(h, 2 * b + 1, 798) AS s FROM (SELECT *, unnest(range(0, n - 199, 200)) AS b FROM d WHERE n >= 200)),
w AS (SELECT r, b + i AS p, md5_number(substr(s, 2 * i + 1, 400)) AS g FROM (SELECT *, unnest(range(0, least(200, n - 199 - b))) AS i FROM b)),
again AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN again USING (g)),
run AS (SELECT r, min(p) AS start, max(p) + 200 AS stop FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM hit) GROUP BY r, k),
part AS (SELECT r, start, stop, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS before FROM run),
cut AS (SELECT r, CAST(sum(stop - start) AS BIGINT) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) || substr(any_value(h), 2 * max(stop) + 1) AS kept FROM part JOIN d USING (r) GROUP BY r)
SELECT d.doc_id, d.n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""


OP7 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
w AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN w.winner IS NULL OR w.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN w.winner IS NULL OR w.winner = p.page_id THEN NULL ELSE w.winner END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)
"""

_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
win AS (SELECT DISTINCT item_id, w[i:i + least(n, 10) - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, greatest(n - 10, 0) + 2)) AS i FROM b WHERE n > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
pos AS (SELECT r, i, k, w[i:i + k - 1] AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
occ AS (SELECT pos.r, pos.i, pos.k, win.item_id FROM pos JOIN win USING (g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM occ GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256, hit.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

OP3 = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, w[i:i + least(len(w), 5) - 1] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r, r AS m FROM d UNION SELECT e.b, c.m FROM c JOIN e ON e.a = c.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT c.r, min(x.doc_id) AS component_id FROM c JOIN d x ON x.r = c.m GROUP BY c.r) k USING (r)
"""


def _url_levels() -> str:
    """The two models of each order, from the one below."""
    out = ""
    for k in range(1, urls.ORDER + 1):
        low = "1.0 / 256" if k == 1 else "{0}0"
        prob = lambda s, low=low: f"CASE WHEN {s}_n = 0 THEN {low.format('p' + s)} ELSE ({s} + {s}_t * {low.format('p' + s)}) / ({s}_n + {s}_t) END"
        below = "" if k == 1 else f" JOIN (SELECT g AS below, pa AS pa0, pb AS pb0 FROM p{k - 1}) ON below = right(g, {k - 1})"
        out += f"""l{k} AS (SELECT right(g, {k}) AS g, sum(a) AS a, sum(b) AS b FROM c GROUP BY 1),
t{k} AS (SELECT left(g, {k - 1}) AS x, sum(a) AS a_n, sum(b) AS b_n, count(*) FILTER (a > 0) AS a_t, count(*) FILTER (b > 0) AS b_t FROM l{k} GROUP BY 1),
p{k} AS (SELECT g, {prob('a')} AS pa, {prob('b')} AS pb FROM l{k} JOIN t{k} ON x = left(g, {k - 1}){below}),
"""
    return out


_PARTS = urls.PARTS
OP5 = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
page AS (SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '{_PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
j AS (SELECT r, page_id, host, path, h || p AS rule, v FROM page LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) = 1),
u AS (SELECT *, left(md5(u), 1) IN ({", ".join(f"'{x}'" for x in urls.CALIBRATION)}) AS cal FROM (SELECT host || path AS u, max(v) AS v FROM j GROUP BY 1)),
pos AS (SELECT u, v, cal, substr(repeat(chr(2), {urls.ORDER - 1}) || u || chr(3), i, {urls.ORDER}) AS g FROM (SELECT u, v, cal, unnest(range(1, length(u) + 2)) AS i FROM u)),
c AS (SELECT g, count(*) FILTER (v = 'allow' AND NOT cal) AS a, count(*) FILTER (v = 'block' AND NOT cal) AS b FROM pos GROUP BY g),
{_url_levels()}score AS (SELECT u, any_value(v) AS v, any_value(cal) AS cal, avg(ln(pa) - ln(pb)) AS llr FROM pos JOIN p{urls.ORDER} USING (g) GROUP BY u),
mid AS (SELECT (coalesce(avg(llr) FILTER (v = 'allow' AND cal), avg(llr) FILTER (v = 'allow')) + coalesce(avg(llr) FILTER (v = 'block' AND cal), avg(llr) FILTER (v = 'block'))) / 2 AS limit_ FROM score)
SELECT page_id, host, path, rule, coalesce(j.v, CASE WHEN limit_ IS NULL OR llr >= limit_ THEN 'allow' ELSE 'block' END) AS verdict
FROM j JOIN score ON score.u = host || path, mid
"""
