"""Queries over texts: cleaning, rules, scalar functions, chunks, metrics."""

from __future__ import annotations

import re
from functools import cache, lru_cache

from pyspark.sql import functions as F

from tarnwell.functions import adapters, chunking, metrics, text
from tarnwell.operators import cleaning, evaluation, hierarchy, relations, selection
from tarnwell.sources.config import Settings, merged
from tarnwell.plans.registry import query
from tarnwell.sources.scratch import scratch, settled
from tarnwell.sources.tables import read_csv

#: SQL pieces: lower-cased words, pairs of turns, white space with the no-break space.
W = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]|\p{{Nd}}', ' ', 'g'), '\s+'), lambda x: x <> '')"
P = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
PAIRS = """pairs AS (SELECT * FROM (SELECT conv_id, turn, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS generated,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS model FROM conversations) WHERE model IS NOT NULL)"""
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
KEYWORDS = f"""sides AS (SELECT conv_id, turn, 0 AS side, {W.format('reference')} AS w FROM pairs UNION ALL SELECT conv_id, turn, 1, {W.format('generated')} FROM pairs),
each AS (SELECT conv_id, turn, side, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM sides),
counts AS (SELECT conv_id, turn, side, word, count(*) AS n, min(pos) AS first FROM each WHERE word NOT IN ({STOP}) GROUP BY ALL),
best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY conv_id, turn, side ORDER BY n DESC, first) <= 20),
byword AS (SELECT conv_id, turn, word, count(*) AS sides, min(side) AS low, max(side) AS high FROM best GROUP BY ALL),
kw AS (SELECT conv_id, turn, CASE WHEN min(low) = 0 AND max(high) = 1 THEN count(*) FILTER (sides = 2) / count(*) ELSE 0 END AS v FROM byword GROUP BY ALL),
keyword AS (SELECT conv_id, turn, CAST(coalesce(v, 0) AS DOUBLE) AS keyword_overlap FROM pairs LEFT JOIN kw USING (conv_id, turn))"""
CAP = r"list_distinct(list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z][a-zA-Z]*$')))"
ENTITY = f"""ent AS (SELECT conv_id, turn, {CAP.format('reference')} AS a, {CAP.format('generated')} AS b FROM pairs),
entity AS (SELECT conv_id, turn, a, b, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS entity_overlap FROM ent)"""
RATIO = f"""len2 AS (SELECT conv_id, turn, len({P.format('reference')}) AS a, len({P.format('generated')}) AS b FROM pairs),
ratio AS (SELECT conv_id, turn, CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE least(a, b) / greatest(a, b) END AS length_ratio FROM len2)"""
KEY = ["conv_id", "turn"]


@query(f"""WITH {PAIRS}, {KEYWORDS}, {ENTITY}, {RATIO}
SELECT model, round(avg(keyword_overlap), 6) AS avg_keyword_overlap, round(avg(entity_overlap), 6) AS avg_entity_overlap, round(avg(length_ratio), 6) AS avg_length_ratio,
  count(*) AS total_samples, count(*) FILTER (generated <> '') AS successful_generations, count(*) FILTER (generated = '') AS failed_generations, count(*) FILTER (generated <> '') / count(*) AS success_rate
FROM pairs JOIN keyword USING (conv_id, turn) JOIN entity USING (conv_id, turn) JOIN ratio USING (conv_id, turn) GROUP BY model""")
def c5_eval_summary(t):
    pairs = evaluation.turn_pairs(t.conversations).withColumn("error", evaluation.generated_error(F.col("generated")))
    r, g = F.col("reference"), F.col("generated")
    scored = pairs.withColumns({"keyword_overlap": metrics.keyword_overlap(r, g), "entity_overlap": text.entity_overlap(r, g), "length_ratio": text.length_ratio(r, g)})
    out = evaluation.summary(scored, "model", ["keyword_overlap", "entity_overlap", "length_ratio"]).drop("error")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("avg_")})


@query(f"WITH {PAIRS}, {KEYWORDS} SELECT * FROM keyword")
def t7_keyword_overlap(t):
    return evaluation.turn_pairs(t.conversations).select(*KEY, metrics.keyword_overlap(F.col("reference"), F.col("generated")).alias("keyword_overlap"))


@query(f"WITH {PAIRS}, {ENTITY} SELECT conv_id, turn, entity_overlap FROM entity")
def t8_entity_overlap(t):
    return evaluation.turn_pairs(t.conversations).select(*KEY, text.entity_overlap(F.col("reference"), F.col("generated")).alias("entity_overlap"))


@query(f"WITH {PAIRS}, {RATIO} SELECT * FROM ratio")
def t9_length_ratio(t):
    return evaluation.turn_pairs(t.conversations).select(*KEY, text.length_ratio(F.col("reference"), F.col("generated")).alias("length_ratio"))


@query(f"""WITH {PAIRS}, {ENTITY}, s AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS i, len(a) AS a, len(b) AS b FROM entity),
pr AS (SELECT conv_id, turn, CASE WHEN b = 0 THEN 1.0 WHEN a = 0 THEN 0.0 ELSE i / b END AS precision, CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN b = 0 THEN 0.0 WHEN a = 0 THEN 1.0 ELSE i / a END AS recall FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr""")
def t10_entity_prf(t):
    prf = text.precision_recall(text.capitalised(F.col("reference")), text.capitalised(F.col("generated")))
    return evaluation.turn_pairs(t.conversations).select(*KEY, prf.alias("s")).select(*KEY, "s.*")


def _grams(tokens: str, orders: str, x: str = "") -> str:
    return f"""tok{x} AS (SELECT conv_id, turn, 0 AS side, {tokens.format('reference')} AS w FROM pairs UNION ALL SELECT conv_id, turn, 1, {tokens.format('generated')} FROM pairs),
g{x} AS (SELECT conv_id, turn, side, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tok{x}, (SELECT unnest({orders}) AS k) WHERE len(w) >= k)),
c{x} AS (SELECT conv_id, turn, k, gram, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS g FROM g{x} GROUP BY ALL),
m{x} AS (SELECT conv_id, turn, k, CAST(sum(least(r, g)) AS BIGINT) AS matched, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(g) AS BIGINT) AS n_gen FROM c{x} GROUP BY ALL)"""


@query(f"""WITH {PAIRS}, {_grams(W, '[1, 2]')}, pr AS (SELECT conv_id, turn, k, CASE WHEN n_gen > 0 THEN matched / n_gen ELSE 0 END AS precision, CASE WHEN n_ref > 0 THEN matched / n_ref ELSE 0 END AS recall FROM m)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS fmeasure FROM pr""")
def t11_rouge_n(t):
    pairs = evaluation.turn_pairs(t.conversations)
    each = pairs.select(*KEY, F.explode(metrics.rouge_n(text.words(F.col("reference")), text.words(F.col("generated")))).alias("s")).select(*KEY, "s.*")
    return each.where("n_ref + n_gen > 0").drop("n_ref", "n_gen")


#: One row of the table of common subsequences after the other: a word of the reference against all of the generated text.
LCS = f"""w AS (SELECT conv_id, turn, {W.format('reference')} AS a, {W.format('generated')} AS b FROM pairs),
dp AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: CAST(0 AS BIGINT)) AS r FROM w
  UNION ALL SELECT conv_id, turn, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 2), lambda j: [CASE WHEN j = 1 THEN CAST(0 AS BIGINT) ELSE greatest(r[j], r[j - 1] + CASE WHEN b[j - 1] = a[i + 1] THEN 1 ELSE 0 END) END]),
    lambda x, y: list_append(x, greatest(x[-1], y[1]))) FROM dp WHERE i < len(a)),
lcs AS (SELECT conv_id, turn, len(a) AS n_a, len(b) AS n_b, r[-1] AS n FROM dp WHERE i = len(a)),
lpr AS (SELECT conv_id, turn, CASE WHEN n_b > 0 THEN n / n_b ELSE 0 END AS precision, CASE WHEN n_a > 0 THEN n / n_a ELSE 0 END AS recall FROM lcs),
rouge_l AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS fmeasure FROM lpr)"""


@query(f"WITH RECURSIVE {PAIRS}, {LCS} SELECT conv_id, turn, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(fmeasure AS DOUBLE) AS fmeasure FROM rouge_l")
def t11_rouge_l(t):
    pairs = evaluation.turn_pairs(t.conversations)
    return pairs.select(*KEY, metrics.rouge_l(text.words(F.col("reference")), text.words(F.col("generated"))).alias("s")).select(*KEY, "s.*")


@query()
def t11_rouge_stemmed(t):
    """ROUGE-1, -2 and -L with stems, as evaluations use it."""
    pairs = evaluation.turn_pairs(t.conversations).withColumns({"r": metrics.rouge_words(F.col("reference")), "g": metrics.rouge_words(F.col("generated"))})
    scored = pairs.select(*KEY, metrics.rouge_n(F.col("r"), F.col("g")).alias("n"), metrics.rouge_l(F.col("r"), F.col("g")).alias("l"))
    return scored.select(*KEY, F.col("n")[0]["fmeasure"].alias("rouge1"), F.col("n")[1]["fmeasure"].alias("rouge2"), F.col("l")["fmeasure"].alias("rougeL"))


_BT = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
_LOG = {k: f"ln((CASE WHEN m{k} = 0 THEN 0.1 ELSE m{k} END) / greatest(g{k}, 1))" for k in (1, 2, 3, 4)}
_SUM = {1: _LOG[1], 2: f"0.5 * {_LOG[1]} + 0.5 * {_LOG[2]}", 3: " + ".join(f"0.33 * {_LOG[k]}" for k in (1, 2, 3)), 4: " + ".join(f"0.25 * {_LOG[k]}" for k in (1, 2, 3, 4))}


BLEU = f"""{_grams(_BT, '[1, 2, 3, 4]', '_b')},
wide_b AS (SELECT conv_id, turn, {', '.join(f'coalesce(max(matched) FILTER (k = {k}), 0) AS m{k}, coalesce(max(n_gen) FILTER (k = {k}), 0) AS g{k}' for k in (1, 2, 3, 4))}, coalesce(max(n_ref) FILTER (k = 1), 0) AS r1 FROM m_b GROUP BY ALL),
b_b AS (SELECT *, CASE WHEN g1 = 0 THEN 0.0 WHEN g1 > r1 THEN 1.0 ELSE exp(1 - r1 / greatest(g1, 1)) END AS bp FROM wide_b),
bleu AS (SELECT conv_id, turn, {', '.join(f'coalesce(CASE WHEN m1 = 0 THEN 0.0 ELSE bp * exp({s}) END, 0.0) AS bleu{k}' for k, s in _SUM.items())} FROM pairs LEFT JOIN b_b USING (conv_id, turn))"""


@query(f"WITH {PAIRS}, {BLEU} SELECT conv_id, turn, {', '.join(f'round(bleu{k}, 9) AS bleu{k}' for k in _SUM)} FROM bleu")
def t12_bleu(t):
    found = evaluation.turn_pairs(t.conversations).select(*KEY, metrics.bleu(F.col("reference"), F.col("generated")).alias("s"))
    return found.select(*KEY, *[F.round(F.col("s")[f"bleu{k}"], 9).alias(f"bleu{k}") for k in metrics.BLEU_WEIGHTS])


@query()
def t13_meteor(t):
    pairs = evaluation.turn_pairs(t.conversations)
    return pairs.select(*KEY, metrics.meteor(text.words(F.col("reference")), text.words(F.col("generated"))).alias("meteor"))


@query("""WITH c AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
p AS (SELECT e.vec_id, e.label, CAST(e.embedding AS DOUBLE[]) AS a, CAST(x.embedding AS DOUBLE[]) AS b FROM embeddings e JOIN c USING (label) JOIN embeddings x ON x.vec_id = c.vec_id)
SELECT vec_id, label, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 9) AS cosine FROM p""")
def t14_cosine(t):
    """Each vector against the first of its label: the first is joined to all, so that work follows the rows."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    return t.embeddings.join(first, "label").select("vec_id", "label", F.round(metrics.cosine(F.col("embedding"), F.col("b")), 9).alias("cosine"))


@query("""WITH v AS (SELECT vec_id // 4 AS four, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT x.four, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) AS c FROM v x JOIN v y ON y.four = x.four + 1),
r AS (SELECT four, avg(m) AS recall FROM (SELECT four, a, max(c) AS m FROM c GROUP BY ALL) GROUP BY four),
p AS (SELECT four, avg(m) AS precision FROM (SELECT four, b, max(c) AS m FROM c GROUP BY ALL) GROUP BY four)
SELECT four, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM p JOIN r USING (four)""")
def t15_greedy_match(t):
    """Vectors of a label in fours, each four matched with the next."""
    rows = t.embeddings.withColumn("four", F.floor(F.col("vec_id") / 4)).groupBy("four").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    both = rows.join(rows.select((F.col("four") - 1).alias("four"), F.col("v").alias("w")), "four")
    return both.select("four", metrics.greedy_match(F.col("v"), F.col("w")).alias("s")).select("four", *[F.round(F.col("s")[c], 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH v AS (SELECT vec_id // 4 AS four, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT four, i, avg(e[i]) AS x FROM v, (SELECT unnest(range(1, (SELECT max(len(e)) + 1 FROM v))) AS i) WHERE i <= len(e) GROUP BY ALL)
SELECT a.four, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 9) AS similarity FROM m a JOIN m b ON b.four = a.four + 1 AND b.i = a.i GROUP BY a.four""")
def t14_mean_pooled(t):
    """Vectors in fours as the token vectors of a text: mean, length 1, product with the next four."""
    rows = t.embeddings.withColumn("four", F.floor(F.col("vec_id") / 4)).groupBy("four").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    both = rows.join(rows.select((F.col("four") - 1).alias("four"), F.col("v").alias("w")), "four")
    return both.select("four", F.round(metrics.semantic_similarity(F.col("v"), F.col("w")), 9).alias("similarity"))


@query(f"""WITH {PAIRS}, a AS (SELECT conv_id, turn, list_distinct({P.format('lower(reference)')}) AS a, list_distinct({P.format('lower(generated)')}) AS b FROM pairs WHERE reference <> '' AND generated <> '')
SELECT conv_id, turn, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM a WHERE len(a) > 0 AND len(b) > 0""")
def t16_answer_overlap(t):
    found = evaluation.turn_pairs(t.conversations).where("reference <> '' AND generated <> ''")
    return found.select(*KEY, metrics.answer_jaccard(F.col("reference"), F.col("generated")).alias("score")).where("score IS NOT NULL")


#: Claims: sentences, cut where a mark has white space behind it but for abbreviations before it; the first five of five words or more.
CLAIMS = rf"""cut AS (SELECT conv_id, turn, reference, string_split('' || generated, '') AS c FROM pairs),
marks AS (SELECT *, list_filter(range(1, len(c) + 1), lambda i: regexp_matches(c[i], '[\s\x{{00A0}}]') AND i > 1 AND c[i - 1] IN ('.', '?', '!')
  AND NOT (i > 4 AND regexp_matches(c[i - 4] || c[i - 2], '^[\p{{L}}\p{{N}}_]{{2}}$') AND c[i - 3] = '.')
  AND NOT (i > 3 AND regexp_matches(c[i - 3] || c[i - 2] || c[i - 1], '^[A-Z][a-z]\.$'))) AS p FROM cut),
parts AS (SELECT conv_id, turn, reference, list_filter(list_transform(range(1, len(p) + 2), lambda k: regexp_replace(regexp_replace(array_to_string(c[CASE WHEN k = 1 THEN 1 ELSE p[k - 1] + 1 END:CASE WHEN k > len(p) THEN len(c) ELSE p[k] - 1 END], ''), '^[\s\x{{00A0}}]+', ''), '[\s\x{{00A0}}]+$', '')),
  lambda s: len({P.format('s')}) >= 5)[1:5] AS claims FROM marks)"""


@query(f"WITH {PAIRS}, {CLAIMS} SELECT conv_id, turn, CAST(unnest(range(0, len(claims))) AS INT) AS pos, unnest(claims) AS claim FROM parts")
def t17_claims(t):
    pairs = evaluation.turn_pairs(t.conversations)
    return pairs.select(*KEY, F.posexplode(text.claims(F.col("generated"))).alias("pos", "claim"))


@query(f"""WITH {PAIRS}, {CLAIMS}, each AS (SELECT conv_id, turn, list_distinct({W.format('claim')}) AS own, list_distinct({W.format('reference')}) AS other FROM (SELECT conv_id, turn, reference, unnest(claims) AS claim FROM parts)),
v AS (SELECT conv_id, turn, CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_intersect(own, other)) / len(own) END AS v FROM each),
s AS (SELECT conv_id, turn, avg(v) AS score, avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END) AS ratio, count(*) AS n FROM v GROUP BY ALL)
SELECT conv_id, turn, coalesce(round(score, 9), 'nan'::DOUBLE) AS score, round(ratio, 9) AS consistency_ratio, CAST(coalesce(n, 0) AS INT) AS claim_count, CASE WHEN n IS NULL THEN '{metrics.NO_CLAIMS}' END AS error FROM pairs LEFT JOIN s USING (conv_id, turn)""")
def t18_claim_score(t):
    found = evaluation.turn_pairs(t.conversations).select(*KEY, metrics.claim_scores(F.col("reference"), F.col("generated")).alias("s"))
    return found.select(*KEY, F.round("s.score", 9).alias("score"), F.round("s.consistency_ratio", 9).alias("consistency_ratio"), "s.claim_count", "s.error")


@query(rf"""WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents),
p AS (SELECT doc_id, list_filter(range(2, len(c) + 1), lambda i: (c[i] IN (' ', chr(10)) AND c[i - 1] IN ('.', '?', '!')) OR (i > 2 AND c[i] = ' ' AND c[i - 1] = '"' AND c[i - 2] IN ('.', '?', '!'))) AS p FROM c)
SELECT doc_id, CAST(len(p) AS INT) AS n, CAST(coalesce(list_sum(p), 0) - len(p) AS BIGINT) AS offsets FROM p""")
def t25_boundaries(t):
    at = text.boundaries(F.col("text"))
    found = t.documents.select("doc_id", at.alias("at"))
    return found.select("doc_id", F.size("at").alias("n"), F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x).alias("offsets"))


@query("SELECT doc_id, length(text) AS tokens FROM documents")
def t23_token_length(t):
    """Lengths by a tokenizer's count; here each character is a token."""
    return t.documents.select("doc_id", adapters.token_length(F.col("text"), len).alias("tokens"))


@query(f"""WITH w AS (SELECT doc_id, list_filter({W.format('text')}, lambda x: regexp_matches(x, '^[a-z]{{{{3,}}}}$') AND NOT list_contains([{STOP}], x)) AS w FROM documents)
SELECT doc_id, md5(array_to_string(w, ' ')) AS lemmas_md5 FROM w""".replace("{{", "{").replace("}}", "}"))
def t24_lemmas(t):
    """Lemmas by a tagger's call: here words of a to z, each its own lemma."""
    return t.documents.select("doc_id", F.md5(adapters.lemmas(F.col("text"), plain_tagger)).alias("lemmas_md5"))


@cache
def _no_word():
    import regex

    return regex.compile(r"(?:[^\p{L}\p{N}_\s]|\p{Nd})+")


@lru_cache(maxsize=50_000)
def _plain_token(word: str) -> adapters.Token:
    return adapters.Token(word, word, stop=word in text.STOP_WORDS) if re.fullmatch("[a-z]+", word) else adapters.Token(word, word, "X")


def plain_tagger(given: str) -> list[adapters.Token]:
    return [*map(_plain_token, _no_word().sub(" ", given.lower()).split())]


_PART = {"precision": "matched / n_gen", "recall": "matched / n_ref"}
_NATIVE = [*evaluation.ROUGE, *evaluation.BLEU, "keyword_overlap", "entity_overlap", "length_ratio", "factcc_score", "factcc_consistency_ratio", "factcc_claim_count"]


@query(f"""WITH RECURSIVE {PAIRS}, {KEYWORDS}, {ENTITY}, {RATIO}, {LCS}, {_grams(W, '[1, 2]')}, {BLEU}, {CLAIMS},
pr AS (SELECT conv_id, turn, k, CASE WHEN n_gen > 0 THEN matched / n_gen ELSE 0 END AS precision, CASE WHEN n_ref > 0 THEN matched / n_ref ELSE 0 END AS recall FROM m),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS fmeasure FROM pr),
rouge AS (SELECT conv_id, turn, {', '.join(f'coalesce(max({part}) FILTER (k = {k}), 0) AS rouge{k}_{part}' for k in (1, 2) for part in ('precision', 'recall', 'fmeasure'))} FROM pairs LEFT JOIN prf USING (conv_id, turn) GROUP BY ALL),
fc AS (SELECT conv_id, turn, list_distinct({W.format('claim')}) AS own, list_distinct({W.format('reference')}) AS other FROM (SELECT conv_id, turn, reference, unnest(claims) AS claim FROM parts)),
fv AS (SELECT conv_id, turn, CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_intersect(own, other)) / len(own) END AS v FROM fc),
fs AS (SELECT conv_id, turn, avg(v) AS score, avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END) AS ratio, count(*) AS n FROM fv GROUP BY ALL),
factcc AS (SELECT conv_id, turn, coalesce(score, 'nan'::DOUBLE) AS factcc_score, ratio AS factcc_consistency_ratio, coalesce(n, 0) AS factcc_claim_count FROM pairs LEFT JOIN fs USING (conv_id, turn)),
a AS (SELECT *, lpr.* EXCLUDE (conv_id, turn) FROM (SELECT conv_id, turn, model, generated FROM pairs) p JOIN keyword USING (conv_id, turn) JOIN (SELECT conv_id, turn, entity_overlap FROM entity) USING (conv_id, turn) JOIN ratio USING (conv_id, turn)
  JOIN (SELECT conv_id, turn, precision AS rougeL_precision, recall AS rougeL_recall, fmeasure AS rougeL_fmeasure FROM rouge_l) lpr USING (conv_id, turn) JOIN rouge USING (conv_id, turn) JOIN bleu USING (conv_id, turn) JOIN factcc USING (conv_id, turn))
SELECT model, {', '.join(f"round(avg(CASE WHEN generated <> '' THEN {m} END), 7) AS avg_{m}" for m in _NATIVE)}, count(*) AS total_samples, count(*) FILTER (generated <> '') AS successful_generations, count(*) FILTER (generated = '') AS failed_generations
FROM a GROUP BY model""".replace("SELECT *, lpr.* EXCLUDE (conv_id, turn) FROM", "SELECT * FROM"))
def c5_native_metrics(t):
    """The whole evaluation run with every metric that needs no model, words without stems; claims by their words."""
    wide = evaluation.turn_pairs(t.conversations)
    scored = evaluation.score(wide, adapters=evaluation.Adapters(classify=metrics.word_share), source="reference", stem=False)
    out = evaluation.summary(scored, "model", _NATIVE).drop("error", "success_rate")
    return out.withColumns({c: F.round(c, 7) for c in out.columns if c.startswith("avg_")})


@query()
def c5_all_metrics(t):
    """The whole evaluation run over turns as texts and roles as models, with the offline stand-ins behind all metrics."""
    scored = evaluation.score(evaluation.turn_pairs(t.conversations), adapters=STAND_INS, source="reference")
    out = evaluation.summary(scored, "model")
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("avg_")})


def _questions(generated):
    """Stand-in for a question generator: each of the first sentences as a question."""
    return F.array_join(F.transform(F.slice(text.sentences(generated), 1, 7), lambda s: F.concat(F.regexp_replace(s, "[.!?]+$", ""), F.lit("?"))), "\n")


def _answers(questions, given):
    """Stand-in for an answering model: the words of a question that the text has."""
    return metrics.once(text.words(given), lambda known: F.transform(questions, lambda q: F.array_join(F.array_intersect(text.words(q), known), " ")))


def _judge(source, generated, reference):
    """Stand-in for a judge: scores from lengths, as JSON between words."""
    value = (F.length(generated) % 10 + 1).cast("string")
    body = F.concat(*[F.concat(F.lit(f'"{f}": {{"wert": '), value, F.lit("}, ")) for f in text.JUDGE_FIELDS], F.lit('"gesamtscore": '), value)
    return F.concat(F.lit("Urteil: {"), body, F.lit("} Ende."))


STAND_INS = evaluation.Adapters(None, lambda c: F.transform(text.capitalised(c), lambda w: F.struct(w.alias("text"), F.lit("X").alias("label"))), _questions, _answers, metrics.word_share, _judge, adapters.sign_vectors)


@query(r"""SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS gesamtscore, CAST(json_extract(props, '$.k') AS DOUBLE) / 10 AS klarheit FROM events""")
def t19_judge_json(t):
    """Judge answers made of the events' numbers, with words around the JSON."""
    body = lambda k: F.concat(F.lit('{"klarheit": {"wert": '), (k / 10).cast("string"), F.lit(', "begründung": "x"}, "gesamtscore": '), k.cast("string"), F.lit("}"))
    k = F.get_json_object("props", "$.k").cast("int")
    answers = t.events.select("event_id", F.concat(F.lit("Urteil:\n"), body(k), F.lit("\nEnde.")).alias("answer"))
    return answers.select("event_id", text.judge_scores(F.col("answer")).alias("s")).select("event_id", "s.gesamtscore", "s.klarheit")


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '') AS t FROM documents),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '(?i)^(Hier ist der Prompt:?|Here is the prompt:?|The prompt would be:?|Folgender Prompt könnte verwendet werden:?)\s*', ''), '```prompt\s*|\s*```$', '', 'g'), '```\s*|\s*```$', '', 'g') AS c1 FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(c1, '^\s*[''"]|[''"]\s*$', '', 'g'), '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '') AS c2 FROM b),
d AS (SELECT *, CASE WHEN length(c2) > 5000 THEN left(c2, 5000) || '...' ELSE c2 END AS c3 FROM c)
SELECT doc_id, md5(CASE WHEN coalesce(t, '') = '' THEN ''
  WHEN regexp_matches(t, '(?i)Fehler bei der Generierung des Prompts|API-Fehler|Your credit balance is too low|invalid_request_error|Fehler:|Error:|Exception:') THEN 'Fehler bei der Generierung des Prompts: Fehlermuster erkannt'
  WHEN regexp_matches(t, '(?i)\{"error":.+\}|"status":\s*(?:4|5)\d{2}|"message":\s*"[^"]*error[^"]*"') THEN 'Fehler bei der Generierung des Prompts: API-Fehlercode erkannt'
  WHEN length(c2) < 10 THEN 'Fehler bei der Generierung des Prompts: Antwort zu kurz'
  WHEN length(regexp_replace(c3, '[\p{L}\p{N}\s\x{00A0}]', '', 'g')) / length(c3) > 0.3 THEN 'Fehler bei der Generierung des Prompts: Ungewöhnlich hoher Anteil an Sonderzeichen'
  ELSE c3 END) AS sanitized_md5 FROM d""")
def t1_sanitize(t):
    return t.documents.select("doc_id", F.md5(text.sanitize(F.col("text"))).alias("sanitized_md5"))


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def t2_tokens(t):
    return t.documents.select("doc_id", text.tokens_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 1200 THEN left(text, 1200) || '...' ELSE text END) AS short_md5 FROM documents")
def t3_truncate(t):
    return t.documents.select("doc_id", F.md5(text.shorten(F.col("text"), 1200)).alias("short_md5"))


@query("SELECT doc_id, md5('Write about ' || lang || E'\\n\\nGerichtsurteil: ' || text) AS prompt_md5 FROM documents")
def t4_prompt(t):
    return t.documents.select("doc_id", F.md5(text.prompt(F.concat(F.lit("Write about "), "lang"), F.col("text"))).alias("prompt_md5"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '')) AS part_md5 FROM documents""")
def t5_extract(t):
    """Outputs that echo their input, and outputs with the mark and a blank line, both give back the text."""
    given = F.concat(F.lit("Prompt "), "source")
    full = F.when(F.col("doc_id") % 2 == 0, F.concat(given, "text")).otherwise(F.concat(F.lit("x Gerichtsurteil: y"), F.lit("\n\n"), "text"))
    return t.documents.select("doc_id", F.md5(text.generated_part(full, given)).alias("part_md5"))


@query(rf"""SELECT doc_id, length(text) AS chars, len({P.format('text')}) AS words, len(list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '[^\s\x{{00A0}}]'))) AS sentences FROM documents""")
def t21_text_stats(t):
    return t.documents.select("doc_id", text.text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(r"""WITH s AS (SELECT lang, regexp_matches(left(text, 50), '\p{Nd}') AS d, regexp_matches(lower(text), 'stadt|land|bundesland|gericht') AS l, (contains(text, '"') OR contains(text, '''''')) AS q, regexp_matches(text, '^\p{Nd}') AS sd FROM documents)
SELECT lang, round(avg(d::INT), 9) AS has_date, round(avg(l::INT), 9) AS has_location, round(avg(q::INT), 9) AS has_quotes, round(avg(sd::INT), 9) AS starts_with_date FROM s GROUP BY lang""")
def t22_structure(t):
    flags = t.documents.select("lang", text.structure(F.col("text")).alias("s")).select("lang", "s.*")
    return flags.groupBy("lang").agg(*[F.round(F.avg(F.col(c).cast("double")), 9).alias(c) for c in flags.columns[1:]])


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])[\s\x{00A0}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^\s\x{00A0}]'))) AS sentences FROM documents""")
def t26_sentences(t):
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("""SELECT e.event_id, CASE WHEN event_type IN ('click', 'view') THEN 'full' ELSE 'hier' END AS eval_type, regexp_replace('run_' || event_type || '_gen_hier_summary', '_gen_hier_summary$|_generated_judgement_summary$', '') AS model FROM events e""")
def t32_names(t):
    file = F.when(F.col("event_type").isin("click", "view"), "run_full.csv").otherwise("run_hier.csv")
    return t.events.select("event_id", text.eval_type(file).alias("eval_type"), text.model_name(F.concat(F.lit("run_"), "event_type", F.lit("_gen_hier_summary"))).alias("model"))


@query("SELECT doc_id, doc_id % 37 AS number FROM documents")
def t34_checkpoint_number(t):
    path = F.concat(F.lit("runs/synthetic_prompts_checkpoint_"), (F.col("doc_id") % 37).cast("string"), F.lit(".csv"))
    return t.documents.select("doc_id", text.checkpoint_number(path).alias("number"))


_CHUNK = r"""u AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '')), lambda x: x <> '') AS parts FROM documents),
v AS (SELECT doc_id, text, flatten(list_transform(parts, lambda p: CASE WHEN length(p) // 4 > 128
  THEN list_transform(list_filter(list_transform(string_split(regexp_replace(p, '([.!?])[\s\x{00A0}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(regexp_replace(s, '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '')), lambda s: s <> ''), lambda s: {'t': s, 'n': length(s) // 4, 'sep': ' '})
  ELSE [{'t': p, 'n': length(p) // 4, 'sep': chr(10) || chr(10)}] END)) AS units FROM u),
f AS (SELECT doc_id, text, list_reduce(list_transform(units, lambda x: {'done': CAST([] AS VARCHAR[]), 'open': x.t, 'held': x.n, 'sep': x.sep}), lambda a, x: CASE
  WHEN a.open <> '' AND a.held + x.held > 128 THEN {'done': list_append(a.done, a.open), 'open': x.open, 'held': x.held, 'sep': x.sep}
  ELSE {'done': a.done, 'open': CASE WHEN a.open = '' THEN x.open ELSE a.open || x.sep || x.open END, 'held': a.held + x.held, 'sep': x.sep} END,
  {'done': CAST([] AS VARCHAR[]), 'open': '', 'held': CAST(0 AS BIGINT), 'sep': ''}) AS s FROM v),
chunks AS (SELECT doc_id, CASE WHEN length(text) // 4 <= 128 THEN [text] WHEN s.open <> '' THEN list_append(s.done, s.open) ELSE s.done END AS c FROM f)"""


@query(f"WITH {_CHUNK} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, length(chunk) // 4 AS tokens, md5(chunk) AS chunk_md5 FROM (SELECT doc_id, unnest(c) AS chunk, unnest(range(1, len(c) + 1)) AS pos FROM chunks)")
def t27_chunks(t):
    made = t.documents.select("doc_id", F.posexplode(chunking.chunks(F.col("text"), 128, "\n")).alias("pos", "chunk"))
    return made.select("doc_id", "pos", text.tokens_estimate(F.col("chunk")).alias("tokens"), F.md5("chunk").alias("chunk_md5"))


@query(f"""WITH {_CHUNK}, e AS (SELECT lang, length(unnest(c)) // 4 AS n FROM chunks JOIN documents USING (doc_id))
SELECT lang, count(*) AS chunks, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, median(n) AS median FROM e GROUP BY lang""")
def a14_chunk_stats(t):
    made = t.documents.select("lang", F.explode(chunking.chunks(F.col("text"), 128, "\n")).alias("chunk")).select("lang", text.tokens_estimate(F.col("chunk")).alias("n"))
    made = settled(made)  # the passes of the selection would cut the texts anew
    out = made.groupBy("lang").agg(F.count("*").alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"))
    middle = selection.quantiles(made, "n", {"median": 0.5}, ["lang"]).withColumnRenamed("lang", "_lang")
    return out.join(middle, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")


_LEVELS = chunking.levels(1 << 12)


@query(f"""WITH {_CHUNK}, n AS (SELECT doc_id, CAST(len(c) AS INT) AS n FROM chunks), d AS (SELECT *, CASE WHEN n > 1 THEN CAST(ceil(log2(n)) AS INT) ELSE 0 END AS depth FROM n)
SELECT doc_id, n, array_to_string(([{', '.join(map(str, _LEVELS))}])[{len(_LEVELS)} - depth + 1:], ',') AS lengths FROM d""")
def h1_levels(t):
    counts = t.documents.select("doc_id", F.size(chunking.chunks(F.col("text"), 128, "\n")).alias("n"))
    return counts.select("doc_id", "n", F.array_join(chunking.level_lengths(F.col("n")), ",").alias("lengths"))


#: Small sizes, so that documents of the tables have several levels.
SMALL = merged(Settings(), {"chunking": {"chunk_size": 128}, "summarization": {"max_context_length": 512, "max_summary_length": 96}})


def _summarized(t, build=hierarchy.FirstSentences):
    chunked = t.documents.select("doc_id", chunking.chunks(F.col("text"), SMALL.chunking.chunk_size, "\n").alias("chunks"))
    return hierarchy.summarize_by_level(chunked, "doc_id", "chunks", scratch(t.spark), SMALL, build)


@query()
def h4_summaries(t):
    """All levels of the hierarchical summaries, by the offline stand-in."""
    return hierarchy.level_rows(_summarized(t), "doc_id").select("doc_id", "level", "chunk_index", F.md5("summary").alias("summary_md5"))


class _Head:
    """Stand-in that SQL can express: as many characters as fit."""

    def summarize(self, prompt: str, text: str, max_tokens: int) -> str:
        return text[: 4 * max_tokens]


def _first_limit() -> str:
    """SQL for the tokens of a summary of level 0, by the number of chunks n: each level above leaves room for more words."""
    s, out, x = SMALL.summarization, "", SMALL.summarization.max_summary_length
    branching = max(2, (s.max_context_length - x) // SMALL.chunking.chunk_size)
    for k in range(1, 12):
        out += f" WHEN n <= {branching**k} THEN {x}"
        x = int(x * s.word_ratio)
    return f"CASE{out} END"


@query(f"""WITH {_CHUNK}, e AS (SELECT doc_id, len(c) AS n, unnest(c) AS chunk, unnest(range(0, len(c))) AS chunk_index FROM chunks)
SELECT doc_id, CAST(0 AS INT) AS level, CAST(chunk_index AS INT) AS chunk_index, md5(left(chunk, 4 * ({_first_limit()}))) AS summary_md5 FROM e""")
def k14_levels_file(t):
    """The levels of a summary run through a CSV; those of chunks, as the file has them."""
    path = f"{scratch(t.spark)}/levels.csv"
    hierarchy.write_levels(_summarized(t, _Head), "doc_id", path)
    found = read_csv(t.spark, path, na=False, backslash=True).select(F.col("doc_id").cast("long"), F.col("level").cast("int"), F.col("chunk_index").cast("int"), F.md5(F.coalesce("summary", F.lit(""))).alias("summary_md5"))
    return found.where("level = 0")


@query("""WITH n AS (SELECT doc_id, list_transform(range(1, doc_id % 7 + 2), lambda k: repeat(chr(CAST(96 + k AS INT)), CAST(40 * k AS INT))) AS s FROM documents),
e AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: {'done': CAST([] AS VARCHAR[]), 'open': [x], 'held': CAST(0 AS BIGINT)}), lambda a, x: CASE
  WHEN len(a.open) > 0 AND a.held + length('Summary ' || (len(a.open) + 1) || ':' || chr(10) || chr(10) || x.open[1]) // 4 > 80
  THEN {'done': list_append(a.done, array_to_string(a.open, chr(10) || chr(10))), 'open': ['Summary ' || (len(a.open) + 1) || ':' || chr(10) || chr(10) || x.open[1]], 'held': CAST(length('Summary ' || (len(a.open) + 1) || ':' || chr(10) || chr(10) || x.open[1]) // 4 AS BIGINT)}
  ELSE {'done': a.done, 'open': list_append(a.open, 'Summary ' || (len(a.open) + 1) || ':' || chr(10) || chr(10) || x.open[1]), 'held': a.held + length('Summary ' || (len(a.open) + 1) || ':' || chr(10) || chr(10) || x.open[1]) // 4} END,
  {'done': CAST([] AS VARCHAR[]), 'open': CAST([] AS VARCHAR[]), 'held': CAST(0 AS BIGINT)}) AS a FROM n)
SELECT doc_id, CAST(len(a.done) + 1 AS INT) AS batches, md5(array_to_string(list_append(a.done, array_to_string(a.open, chr(10) || chr(10))), '|')) AS batches_md5 FROM e""")
def h3_merge_batches(t):
    """One to seven summaries of growing lengths, packed into merge requests of 80 tokens."""
    letters = F.transform(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 7 + 1), lambda k: F.repeat(F.char(96 + k), (40 * k).cast("int")))
    packed = t.documents.select("doc_id", hierarchy.merge_batches(letters, F.lit(80)).alias("b"))
    return packed.select("doc_id", F.size("b").alias("batches"), F.md5(F.array_join("b", "|")).alias("batches_md5"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 THEN 'Given the context:' || chr(10) || lang || chr(10) || chr(10) || 'Summarize the following in approximately 585 words:' || chr(10) || chr(10) || text
  ELSE 'Merge and summarize the following summaries in approximately 585 words:' || chr(10) || chr(10) || text END) AS merge_md5,
  md5('Summarize the following text in approximately 585 words:' || chr(10) || chr(10) || text) AS chunk_md5 FROM documents""")
def h2_prompts(t):
    """The requests for chunks and for merged summaries, some with a context."""
    words = hierarchy.words_for(F.lit(900), 0.65)
    context = F.when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return t.documents.select("doc_id", F.md5(hierarchy.chunk_prompt(F.col("text"), words, 1, context)).alias("merge_md5"), F.md5(hierarchy.chunk_prompt(F.col("text"), words, 0)).alias("chunk_md5"))


@query("""WITH r AS (SELECT doc_id, lang || chr(10) || chr(10) || text AS j, lang || chr(10) || chr(10) || left(text, 4 * greatest(512 - 96 - 10 - length(lang) // 4, 0)) AS c FROM documents)
SELECT doc_id, md5(CASE WHEN length(j) // 4 > 512 - 96 THEN c ELSE j END) AS request_md5 FROM r""")
def h6_release(t):
    """Requests for final texts: summaries are cut where they don't fit."""
    return t.documents.select("doc_id", F.md5(hierarchy.release_input(F.col("lang"), F.col("text"), 512, 96)).alias("request_md5"))


@query()
def c10_hierarchical_run(t):
    """Chunks, hierarchical summary and final text of each document."""
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("judgement"), F.concat(F.lit("Write about "), "lang").alias("synthetic_prompt"))
    return hierarchy.run(rows, "stand_in", SMALL).select("id", F.md5("stand_in").alias("release_md5"))


_PARAGRAPHS = _CHUNK.replace("string_split(text, chr(10))", r"string_split_regex(text, '\n[\s\x{00A0}]*\n+')")


@query(rf"WITH {_PARAGRAPHS} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, length(chunk) // 4 AS tokens, md5(chunk) AS chunk_md5 FROM (SELECT doc_id, unnest(c) AS chunk, unnest(range(1, len(c) + 1)) AS pos FROM chunks)")
def t27_paragraphs(t):
    """Chunks by the default rule for paragraphs."""
    made = t.documents.select("doc_id", F.posexplode(chunking.chunks(F.col("text"), 128)).alias("pos", "chunk"))
    return made.select("doc_id", "pos", text.tokens_estimate(F.col("chunk")).alias("tokens"), F.md5("chunk").alias("chunk_md5"))


@query(rf"WITH {_PARAGRAPHS}, e AS (SELECT length(unnest(c)) // 4 AS n FROM chunks) SELECT count(*) AS chunks, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, median(n) AS median FROM e")
def c9_run_chunking(t):
    """The chunking run of a configuration: its statistics."""
    stats = hierarchy.run_chunking(t.documents.withColumn("judgement", F.col("text")), SMALL)[1]
    return stats.withColumn("mean", F.round("mean", 9))


_SAMPLES = {
    0: "'Terminvorschau für die Woche'", 1: "'Die Einladung zum Gespräch am ' || {full14} || ' folgt.'", 2: "'Pressetermin vom ' || {past} || ' entfällt'", 3: "'Hier wird verhandelt am ' || {short30} || ' im Saal'",
    4: "'Das Urteil vom ' || {past} || ' ist ergangen.'", 5: "'Veranstaltung: demnächst mehr'", 6: "'Einladungsübersicht am ' || {full14}", 7: "repeat('x', 495) || ' Terminvorschau, Einladung am 31.02.2023'",
    8: "'Pressekonferenz findet am ' || {full14} || ' statt, terminiert auf den ' || {short30}", 9: "NULL", 10: "'Zur Information: Rundgang in der nächsten Woche'", 11: "'Einladung am ' || {past} || ' und vom ' || {full14}",
}


def _samples(day: str, form: str) -> str:
    """Summaries with announcements made of an order's key and date; form formats a day in dd.mm.yyyy or dd.mm."""
    full, short = form.split("|")
    days = {"full14": full.format(f"{day} + INTERVAL 14 DAY"), "past": full.format(f"{day} - INTERVAL 100 DAY"), "short30": short.format(f"{day} + INTERVAL 30 DAY")}
    return "CASE o_orderkey % 12 " + " ".join(f"WHEN {k} THEN {v.format(**days)}" for k, v in _SAMPLES.items()) + " END"


def _rule_sql() -> str:
    q = lambda p: p.replace("'", "''")
    h = ", ".join(f"CASE WHEN contains(left(l, 500), '{p}') THEN 'Headline: {p}' END" for p in cleaning.HEADLINES)
    k = ", ".join(rf"CASE WHEN regexp_matches(l, '(^|[^\p{{L}}\p{{N}}_])\Q{p}\E([^\p{{L}}\p{{N}}_]|$)') THEN 'Keyword: {p}' END" for p in cleaning.KEYWORDS)
    z = ", ".join(f"CASE WHEN regexp_matches(l, '{p}') THEN 'Zeitraum: {p}' END" for p in cleaning.PERIODS)
    d = ", ".join(
        f"list_transform(list_zip(regexp_extract_all(l, '{q(p)}', 0), regexp_extract_all(l, '{q(p)}', 1), regexp_extract_all(l, '{q(p)}', 2), regexp_extract_all(l, '{q(p)}', 3)), "
        "lambda x: {'a': x[1], 'day': try_strptime(printf('%s-%s-%s', lpad(coalesce(nullif(x[4], ''), CAST(year(pub) AS VARCHAR)), 4, '0'), lpad(x[3], 2, '0'), lpad(x[2], 2, '0')), '%Y-%m-%d')})"
        for p in cleaning.DATE_PATTERNS
    )
    return f"""src AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS pub, {_samples('CAST(o_orderdate AS DATE)', "strftime({0}, '%d.%m.%Y')|strftime({0}, '%d.%m.')")} AS summary FROM orders),
l AS (SELECT *, lower(summary) AS l FROM src),
s AS (SELECT *, list_filter([{h}], lambda x: x IS NOT NULL) AS h, list_filter([{k}], lambda x: x IS NOT NULL) AS k, list_filter([{z}], lambda x: x IS NOT NULL) AS z,
  list_transform(list_filter(flatten([{d}]), lambda x: x.day > pub), lambda x: 'Datum: ' || x.a || ' (+' || date_diff('day', pub, CAST(x.day AS DATE)) || ' Tage)') AS d FROM l),
r AS (SELECT *, coalesce(len(h) > 0 OR (len(k) > 0 AND len(z) + len(coalesce(d, [])) > 0), false) AS flag, array_to_string(list_concat(h, k, coalesce(d, []), z), ' | ') AS all_criteria FROM s)"""


def _ruled(t):
    """The announcement rule with its own lists and dates, over summaries made of orders."""
    made = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("pub"), F.expr(_samples("CAST(o_orderdate AS DATE)", "date_format({0}, 'dd.MM.yyyy')|date_format({0}, 'dd.MM.')")).alias("summary"))
    out = made.withColumn("r", cleaning.announcement(F.col("summary"), F.col("pub")))
    return out.select("o_orderkey", "o_orderpriority", F.col("r.flag").alias("flag"), F.col("r.criteria").alias("criteria"))


@query(f"WITH {_rule_sql()} SELECT o_orderkey, flag, CASE WHEN flag THEN all_criteria END AS criteria FROM r")
def p1_rule_flags(t):
    return _ruled(t).select("o_orderkey", "flag", "criteria")


@query(f"WITH {_rule_sql()} SELECT round(avg(flag::INT) * 100, 6) AS percent, count(*) FILTER (flag) AS flagged, count(*) AS total FROM r")
def p2_flag_share(t):
    return _ruled(t).agg(F.round(F.avg(F.col("flag").cast("double")) * 100, 6).alias("percent"), F.sum(F.col("flag").cast("long")).alias("flagged"), F.count("*").alias("total"))


@query(f"WITH {_rule_sql()}, e AS (SELECT unnest(string_split(all_criteria, ' | ')) AS criterion FROM r WHERE flag) SELECT criterion, count(*) AS n, string_split(criterion, ':')[1] AS kind FROM e GROUP BY criterion")
def a6_criteria_hist(t):
    return cleaning.criteria_histogram(_ruled(t), "criteria")


@query(f"WITH {_rule_sql()} SELECT o_orderpriority, CASE WHEN count(*) FILTER (flag) > 0 THEN round(count(*) FILTER (flag) * 100 / count(*), 9) END AS share FROM r GROUP BY o_orderpriority")
def a7_flag_share(t):
    n = F.sum(F.col("flag").cast("long"))
    return _ruled(t).groupBy("o_orderpriority").agg(F.when(n > 0, F.round(n * 100 / F.count("*"), 9)).alias("share"))


@query(f"WITH {_rule_sql()} SELECT CASE WHEN flag THEN 'removed' ELSE 'cleaned' END AS status, count(*) AS n FROM r GROUP BY ALL")
def k2_split_counts(t):
    return cleaning.split_by_flag(_ruled(t), "flag").groupBy("status").agg(F.count("*").alias("n"))


_PHRASES = ["idiot", "Licensed under", "%%%"]


@query("""SELECT * FROM (SELECT 'missing' AS "check", 'text' AS subject, count(*) FILTER (coalesce(text, '') = '') AS found FROM documents
UNION ALL SELECT 'missing', 'lang', count(*) FILTER (coalesce(lang, '') = '') FROM documents
""" + "".join(f"UNION ALL SELECT 'phrase', '{p}', count(*) FILTER (contains(text, '{p}')) FROM documents\n" for p in _PHRASES) + """
UNION ALL SELECT 'nul', c, n FROM (SELECT count(*) FILTER (contains(text, chr(0))) AS n, 'text' AS c FROM documents UNION ALL SELECT 0, 'lang' UNION ALL SELECT 0, 'source')
UNION ALL SELECT 'too_long', 'text', greatest(max(length(text)) - 10000, 0) FROM documents UNION ALL SELECT 'too_long', 'lang', 0 UNION ALL SELECT 'too_long', 'source', 0
UNION ALL SELECT 'repeated_ids', 'source', count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(*) > 1))""")
def p5_validate(t):
    return cleaning.audit(t.documents, "source", ["text", "lang"], "text", _PHRASES, 10_000)


@query("""SELECT doc_id, md5(text) AS text_md5 FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) WHERE NOT contains(text, 'idiot') AND NOT contains(text, '%%%') AND coalesce(lang, '') <> ''""")
def p6_clean(t):
    return cleaning.clean(t.documents, "text", "doc_id", ["lang", "text"], "text", ["idiot", "%%%"]).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id FROM documents WHERE NOT coalesce(contains(text, '%%%') OR contains(text, 'idiot'), false)")
def p7_drop_phrases(t):
    return t.documents.where(~text.any_contains(F.col("text"), ["%%%", "idiot"])).select("doc_id")


@query("""WITH v AS (SELECT source, count(*) FILTER (contains(text, '%%%')) AS p, count(*) FILTER (coalesce(text, '') = '' OR coalesce(lang, '') = '') AS m, count(*) FILTER (NOT contains(text, '%%%') AND coalesce(text, '') <> '' AND coalesce(lang, '') <> '') AS valid FROM documents GROUP BY source)
SELECT source, p = 0 AND m = 0 AS ok, valid, CASE WHEN p > 0 THEN p || ' rows with error phrases' WHEN m > 0 THEN m || ' rows with missing values' ELSE 'sound' END AS message FROM v""")
def p8_verify(t):
    return cleaning.verdicts(t.documents, "source", "text", ["text", "lang"], ["%%%"])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{p}' AS phrase, count(*) AS "rows" FROM documents WHERE contains({c}, '{p}') HAVING count(*) > 0""" for c in ("text", "lang") for p in ("en", "idiot", "%%%")))
def p9_phrase_audit(t):
    return cleaning.phrase_audit(t.documents, ["text", "lang"], ["en", "idiot", "%%%"])


@query("SELECT doc_id, CASE WHEN contains(text, '%%%') THEN NULL ELSE md5(text) END AS prompt_md5 FROM documents")
def p13_reset_retry(t):
    return cleaning.reset_failed(t.documents, "text", ["%%%"]).select("doc_id", F.md5("text").alias("prompt_md5"))


@query("SELECT doc_id FROM documents WHERE doc_id >= 100 AND contains(text, '%%%')")
def p14_to_do(t):
    return cleaning.to_do(cleaning.reset_failed(t.documents, "text", ["%%%"]), "text", "doc_id", 100).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id < 300 THEN 'done ' || lang END AS prompt FROM documents")
def p15_carry_over(t):
    open_ = t.documents.select("doc_id", F.lit(None).cast("string").alias("prompt"))
    done = t.documents.select("doc_id", F.concat(F.lit("done "), "lang").alias("prompt"))
    return cleaning.carry_over(open_, done, "doc_id", "prompt", 300)


@query(r"""SELECT doc_id, (regexp_matches(text, '[^\s\x{00A0}]') AND length(text) // 4 <= 900 AND regexp_matches(text, '[.!?"''][\s\x{00A0}]*$')) AS valid FROM documents""")
def p19_summary_valid(t):
    return t.documents.select("doc_id", text.ends_whole(F.col("text"), 900).alias("valid"))


@query("SELECT count(*) FILTER (coalesce(text, '') = '') AS no_text, count(*) - count(DISTINCT text) AS repeated, count(*) FILTER (trim(lang) = '') AS no_lang FROM documents")
def p22_missing(t):
    n = lambda c: F.sum(c.cast("long"))
    return t.documents.agg(n(cleaning.blank(F.col("text"))).alias("no_text"), (F.count("*") - F.countDistinct("text")).alias("repeated"), n(F.trim("lang") == "").alias("no_lang"))


@query()
def j9_near_dup(t):
    """The benchmark's items, each with a copy that ends otherwise."""
    copies = t.benchmark.select((-F.col("item_id") - 1).alias("item_id"), F.concat(F.expr("left(text, greatest(length(text) - 4, 0))"), F.lit("1234")).alias("text"))
    return relations.near_duplicates(t.benchmark.select("item_id", "text").unionByName(copies), "item_id", "text", 0.9)
