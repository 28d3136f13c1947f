"""The corpus operators against brute force, libraries, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tarnwell.llm import bpe, decontam, langid, ngram_join, quality, queries, rules, sa_dedup, toxicity, urls, warc
from tarnwell.llm.common import fold
from tarnwell.llm.components import components

DATA = "/root/testdata/sf0.01"
BPE_FILE = queries.TOKENIZER
#: Nulls, blanks, one word, a very long text, repeated rows and null ids; every operator must take them.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "12 34 ##"), (6, "lang " * 30_000), (7, "same text here"), (7, "same text here"), (None, "no id at all"), (None, None), (8, "İΣς ﷺ e\u0301 \x00 \u2028 x")]


def frame(spark, rows, extra=True):
    """doc_id and text, with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("key", "n", "score", "o", "row", "u", "y", "token", "root", "part")}) if extra else df


def ids(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


# ---- BPE


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(BPE_FILE), bpe.WordBpe(BPE_FILE)
    rng = random.Random(1)
    signs = list("abc 'stΣσςİßÉé٠²½Ⅷ한語\U0001f600\n\t\x1c\x85\xa0\u3000\u2028\u200bABCthe") + ["<|endoftext|>", "\u0301", "\u030a", "A\u030a"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 3000, "<|startoftext|><|endoftext|> x"]
    for text in texts:
        got, want = np.frombuffer(own.encode(text), "<u4"), library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, text
        assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_pairs_agree_with_plain_merging():
    own = bpe.WordBpe(BPE_FILE)
    rng = random.Random(2)

    def merged(text):
        parts = [own.texts.index(c) for c in text]
        while True:
            best = min(((own.joined[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in own.joined), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [best[0]]

    for _ in range(150):
        a, b = rng.randrange(len(own.texts)), rng.randrange(len(own.texts))
        assert own.compatible(a, b) == (merged(own.texts[a] + own.texts[b]) == [a, b])


def test_bpe_odd_rows(spark):
    got = bpe.digests(frame(spark, ODD), BPE_FILE).collect()
    assert len(got) == len(ODD)
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got if r.doc_id in (1, 2, 3))
    assert bpe.digests(frame(spark, []), BPE_FILE).count() == 0
    row = bpe.encode_decode(frame(spark, [(4, "The word")]), BPE_FILE).first()
    assert bytes(row.decoded) == b"the</w> word</w>"


# ---- language, quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    return read("documents"), read("labels")


def test_langid_held_out(spark, tables):
    docs, _ = tables
    found = queries.op2_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_langid_odd_rows(spark, tables):
    learned = langid.train(tables[0], F.lit(True))
    assert set(learned) == {"en", "de", "fr", "es"} and max(map(len, learned.values())) <= 1 << 15
    got = {(r.doc_id): r for r in langid.predict(frame(spark, ODD), learned).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 5))
    assert got[4].lang_pred in learned and got[6].lang_pred in learned
    bare = frame(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(bare, F.lit(True)) == {}
    assert {r.lang_pred for r in langid.predict(bare, {}).collect()} == {"und"}


def test_langid_learns_every_language(spark):
    rng = random.Random(13)
    word = lambda signs: "".join(rng.choice(signs) for _ in range(6))
    words = [[word(rng.sample("abcdefghijklmnopqrstuvwxyz", 8)) for _ in range(30)] for _ in range(230)]
    say = lambda k: " ".join(rng.choice(words[k]) for _ in range(40))
    rows = [(i, say(i % 230), f"x-{i % 230}") for i in range(920)] + [(5000, "1 2 3", "digits")] + [(6000, "many copies", "copied")] * 900 + [(6001, "one other", "copied")]
    learned = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(learned) == {f"x-{k}" for k in range(230)} | {"copied"}
    small = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), all_bytes=231 * 128)
    assert set(small) == set(learned) and max(map(len, small.values())) <= 128
    asked = spark.createDataFrame([(k, say(k)) for k in range(230)], "doc_id long, text string")
    assert np.mean([r.lang_pred == f"x-{r.doc_id}" for r in langid.predict(asked, learned).collect()]) > 0.97


def test_langid_sample_is_spread_over_rows_and_texts(spark):
    name = lambda n: "".join(chr(97 + int(d)) for d in f"{n:05d}")
    rows = [(i, " ".join(["opening"] * 800 + ["z" + name(i)] * 800), "en") for i in range(2000)]
    content = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))["en"]
    taught = {w for w in content.decode().split() if len(w) == 6 and w[0] == "z"}
    ids_ = np.array(sorted(int("".join(str(ord(c) - 97) for c in w[1:])) for w in taught))
    assert 0.25 < content.count(b"z") / (content.count(b"z") + content.count(b"opening")) < 0.75
    assert len(ids_) > 120 and all(n > 15 for n in np.histogram(ids_, 5, (0, 2000))[0])
    assert langid.evenly([b"a" * 3, b"b" * 90, b"c" * 50], 62) == b"aaa " + b"b" * 28 + b" " + b"c" * 28


def test_langid_compares_compressed_sizes_and_ties_go_to_the_first():
    rng = random.Random(22)
    say = lambda signs, n: " ".join("".join(rng.choice(signs) for _ in range(5)) for _ in range(n))
    first = say("abcdef", 400).encode()
    dictionaries = {"x": first, "y": say("defghi", 400).encode(), "z": first}
    judge = langid.Compressor(dictionaries, 6, 256).judge
    for text in [say("abcdef", 30), say("defghi", 200), say("ghi", 9), "Q", None, "12"]:
        plain = langid.letters_only(text).encode()
        size = {}
        for name, content in dictionaries.items():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=6)
            size[name] = sum(len(zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(plain[i : i + 256])) for i in range(0, len(plain), 256))
        found, score, rejected = judge(text, 0.01)
        if not plain:
            assert (found, score) == ("und", 0.0)
            continue
        assert found == min(size, key=lambda k: (size[k], list(size).index(k))) and found != "z"
        best, second = sorted(size.values())[:2]
        assert rejected == ((second - best) / second < 0.01)


def test_folds(spark):
    got = spark.createDataFrame([(i,) for i in [0, 7, -3, 10**15, None]], "doc_id long").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r.f == (0 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5) for r in got)


def test_quality_held_out(spark, tables):
    found = queries.op1_quality(spark, DATA).join(tables[1], "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95


def test_statistics_are_those_of_whole_texts(monkeypatch):
    rng = random.Random(21)
    texts = ["".join(rng.choice(["ab ", "AB", "é", "1.\n", "! ", "|", "\n\n", "\t", "the the ", "x"]) for _ in range(rng.randint(0, 400))) for _ in range(60)] + [None, "", " \n"]
    monkeypatch.setattr(quality, "STEP", 64)
    for text, got in zip(texts, quality.statistics(pa.array(texts))):
        raw = (text or "").encode()
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        inside = lambda c: sum(bytes([b]) in c.encode() for b in raw if b < 128)
        shares = [inside(c) for c in quality.CLASSES]
        beyond = sum(b >= 128 for b in raw)
        want = [x / max(1, len(raw)) for x in (*shares, len(raw) - sum(shares) - beyond, beyond)]
        w = len(words)
        want += [0.0] * 10 if not w else [
            np.log1p(len(raw)), np.log1p(w), sum(map(len, words)) / w, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:])) / w, w / len(lines),
            1 - len(set(lines)) / len(lines), sum(len(x) < 3 for x in words) / w, sum(x[-1:] in b".!?" for x in lines) / len(lines), np.log1p(max(map(len, words))),
        ]
        assert got == pytest.approx(want)


def test_trees_find_a_rule_and_score_as_walked():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.5)).astype(float)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    for row in x[2000:2005]:
        total = trees.base
        for t in range(len(trees.leaf)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.threshold[t, node])
            total += trees.leaf[t, node - trees.feature.shape[1]]
        assert trees.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_classifiers_take_odd_rows(spark, tables):
    odd = frame(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for made, name in ((quality, "quality"), (toxicity, "toxic")):
        for taught in (labels, labels.limit(0), tables[1]):
            model = made.train(tables[0] if taught is tables[1] else odd, taught, F.lit(True))
            got = made.score(odd, model).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got), name
        assert made.score(odd.limit(0), model).count() == 0


def test_toxicity_held_out(spark, tables):
    found = queries.op6_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert found.predicted[found.toxic == 0].mean() < 0.005
    assert found.predicted[found.toxic == 1].mean() > 0.8


def test_factorization_learns_a_pair():
    rng = np.random.default_rng(3)
    has = rng.random((4000, 6)) < 0.5
    y = (has[:, 0] & has[:, 1]).astype(float)  # neither term is enough alone
    owners, places = np.nonzero(has)
    machine = toxicity.fit(owners, places, y, hash_bits=4)
    p = machine.logistic(np.array([machine.rows[k] for k in places if k in machine.rows]), owners[np.isin(places, list(machine.rows))], 4000)
    assert ((p > 0.5) == (y == 1)).mean() > 0.98
    v = machine.vectors[machine.rows[0]] @ machine.vectors[machine.rows[1]]
    assert v > 0.5


def test_factorization_learns_terms_that_tell_in_company_only():
    rng = np.random.default_rng(3)
    has = rng.random((20_000, 6)) < 0.5
    y = (has[:, 0] ^ has[:, 1]).astype(float)  # alone, each term is as likely in both classes
    owners, places = np.nonzero(has)
    machine = toxicity.fit(owners, places, y, hash_bits=4)
    assert {0, 1} <= set(machine.rows)
    known = np.isin(places, list(machine.rows))
    p = machine.logistic(np.array([machine.rows[k] for k in places[known]]), owners[known], len(y))
    assert ((p > 0.5) == (y == 1)).mean() > 0.98


@pytest.mark.parametrize("frequent", [1500, 5000])
def test_a_pair_among_any_number_of_more_frequent_terms(frequent):
    """Two terms of 150 rows that are toxic together only, while as large a share of all rows is toxic: no number of commoner terms hides them."""
    rng, n = np.random.default_rng(5), 6000
    common = rng.integers(0, frequent, (n, 160 * frequent // n))
    first, second, third, rest = np.split(rng.permutation(n), [60, 150, 240])
    y = np.zeros(n)
    y[first] = 1
    y[rest[: int(0.4 * len(rest))]] = 1
    has = {frequent: {*first, *second}, frequent + 1: {*first, *third}}
    rows = [np.unique(np.append(common[i], [t for t in has if i in has[t]]).astype(np.uint32)) for i in range(n)]
    owners, places = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
    assert np.median(np.bincount(places)[:frequent]) > 150
    machine = toxicity.fit(owners, places, y, hash_bits=15)
    assert {frequent, frequent + 1} <= set(machine.rows)
    score = lambda own: machine.logistic(np.array([machine.rows[t] for t in own]), np.zeros(len(own), np.int64), 1)[0]
    assert score([frequent, frequent + 1]) > 0.9 and score([frequent]) < 0.3 and score([frequent + 1]) < 0.3


@pytest.mark.parametrize("seed", range(6))
def test_telling_pairs_are_those_of_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, width = 1500, 40
    has = rng.random((n, width)) < rng.choice([0.02, 0.1, 0.4, 0.8], width)
    y = (rng.random(n) < np.where(has[:, 3] & has[:, 7], 0.8, 0.2)) & ~(has[:, 5] & has[:, 9] & (rng.random(n) < 0.9))
    p = np.clip(rng.choice([0.1, 0.2, 0.35], n) + (0.0 if seed % 2 else rng.random(n) * 0.2), 0.01, 0.99)
    known, usable = rng.random(width) < 0.2, rng.random(width) < 0.9
    owners, places = np.nonzero(has)
    for one, q in ((y, p), (~y, 1 - p)):
        for clear in (1.5, 2.5, 4.0):
            want = np.zeros(width, bool)
            for a in range(width):
                for b in range(a):
                    rows = has[:, a] & has[:, b]
                    if usable[a] and usable[b] and not (known[a] and known[b]) and rows.any():
                        k, total, expected = float((rows & one).sum()), float(rows.sum()), q[rows].sum()
                        if k > expected and k * np.log(k / expected) + (np.log((total - k) / (total - expected)) * (total - k) if total > k else 0) > clear**2 / 2:
                            want[[a, b]] = True
            assert (toxicity.telling_pairs(owners, places, one, q, known, usable, clear) == want).all() and (clear > 2 or want.any())


def test_machine_scores_as_all_pairs_summed():
    rng = random.Random(18)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("xxxxx", "yyyyy", "zz")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "not known", "AXXXXX axxxxx"]
    places = sorted({p for t in texts[:50] for p in toxicity.places_in(t, 10, 4)})
    made = np.random.default_rng(19)
    machine = toxicity.Machine({p: i for i, p in enumerate(places)}, made.normal(size=len(places)), made.normal(size=(len(places), 3)), -0.4, 10, 4)
    got = machine.score(texts)
    for text, score in zip(texts, got):
        own = [machine.rows[p] for p in toxicity.places_in(text, 10, 4) if p in machine.rows]
        margin = machine.bias + sum(machine.weights[i] for i in own) + sum(float(machine.vectors[a] @ machine.vectors[b]) for k, a in enumerate(own) for b in own[:k])
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_toxicity_sample_is_bounded(spark):
    rows = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k)}q" for k in range(10)), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    whole = toxicity.fit
    try:
        toxicity.fit = lambda owners, places, y, *a, **b: seen.append((len(y), len(places))) or whole(owners, places, y, *a, **b)
        for most in (10_000, 500, 1):
            toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True), max_entries=most, prefix_chars=9)
    finally:
        toxicity.fit = whole
    assert seen == [(200, 2000), (50, 500), (1, 10)]


# ---- rules


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, tables):
    docs, labels = tables
    field = rules.train(docs, labels)
    rng = random.Random(4)
    rows = ODD + [(100 + i, "".join(rng.choice(["ab ", "cd ", "é ", "#", "\n", "\n\n", "\t", "x y z w v "]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    got = rules.judge(frame(spark, rows), field).collect()
    want = Counter((i, *base_rules(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    larger = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    judged = rules.judge(larger[0], rules.train(*larger)).join(larger[1], "doc_id").where("not base_failed").toPandas()
    assert judged.kept[judged.quality == 1].mean() > 0.98 and judged.kept[judged.quality == 0].mean() < 0.1
    assert rules.judge(frame(spark, []), field).count() == 0
    plain = rules.train(docs, labels.limit(0))
    assert rules.judge(docs, plain).where("kept = base_failed").count() == 0  # all lines are content


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    field = rules.Field(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    doc = np.repeat(np.arange(8), [1, 5, 3, 7, 2, 6, 4, 1])
    lines = rules.Lines(doc, rng.normal(size=(len(doc), 3)), np.ones(len(doc)))
    state = field.viterbi(lines)
    for d in range(8):
        x = lines.features[doc == d] @ field.unary
        paths = [[p >> k & 1 for k in range(len(x))] for p in range(1 << len(x))]
        value = lambda s, x=x: field.start[s[0]] + sum(v for v, b in zip(x, s) if b) + sum(field.step[a, b] for a, b in zip(s, s[1:]))
        assert state[doc == d].tolist() == max(paths, key=value)


# ---- URLs


def judged(rows, rule_list):
    """host, path, rule, verdict of each URL by plain Python."""
    parts = []
    for url in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        parts.append((host, m[2] if m else ""))
    fitting = lambda h, p: [r for r in rule_list if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
    best = [max(fitting(*x), key=lambda r: len(r[0] + r[1]), default=None) for x in parts]
    texts = {h + p: (b[2] if b else None) for (h, p), b in zip(parts, best)}
    counts = {s: Counter() for s in ("allow", "block")}
    grams_of = lambda u: [("\2" * 3 + u + "\3")[i : i + 4] for i in range(len(u) + 1)]
    calibrates = {u: hashlib.md5(u.encode()).hexdigest()[0] in "0123" for u in texts}
    for u, v in texts.items():
        if v and not calibrates[u]:
            for g in grams_of(u):
                for k in range(1, 5):
                    counts[v][g[4 - k :]] += 1

    def p(side, g):
        if not g:
            return 1 / 256
        inner = {x: c for x, c in counts[side].items() if len(x) == len(g) and x[:-1] == g[:-1]}
        n, t, low = sum(inner.values()), len(inner), p(side, g[1:])
        return low if not n else (inner.get(g, 0) + t * low) / (n + t)

    cache = {}
    llr = lambda g: cache.setdefault(g, np.log(p("allow", g)) - np.log(p("block", g)))
    score = {u: float(np.mean([llr(g) for g in grams_of(u)])) for u in texts}
    apart = lambda s: [score[u] for u, v in texts.items() if v == s and calibrates[u]] or [score[u] for u, v in texts.items() if v == s]
    mean = {s: np.mean(apart(s)) if s in texts.values() else None for s in counts}
    limit = None if None in mean.values() else (mean["allow"] + mean["block"]) / 2
    out = []
    for (h, q), b in zip(parts, best):
        by_model = "allow" if limit is None or score[h + q] >= limit else "block"
        out.append((h, q, b[0] + b[1] if b else None, b[2] if b else by_model))
    return out


def test_urls(spark):
    rng = random.Random(6)
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?y#z", "http://net/", "http://a.net", "http://example.net/en", "x://y://z/p", "http://ÄB.org/fr/ü?q", "http://xexample.com/de/a", "http://a.example.com/de/\nb"]
    words = ["spam", "news", "shop", "pills", "blog"]
    urls_ = odd + [f"http{rng.choice(['', 's'])}://{rng.choice(words)}{rng.randint(0, 5)}.{rng.choice(['example.com', 'example.net', 'example.org', 'a.net'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(0, 40)}" for _ in range(150)]
    df = spark.createDataFrame([(i if i % 9 else None, u, "x") for i, u in enumerate(urls_)], "page_id long, url string, u string").repartition(3)
    got = [tuple(r)[1:] for r in urls.judge(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert Counter(got) == Counter(judged(urls_, queries.URL_RULES))
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_urls_stay_in_the_engine(spark):
    plan = queries.op5_urls(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>" + "ä" * 600, "x" * 1000
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", None), (5, "u", ""), (6, "v", "small"), (7, "v", "small"), (None, "w", other), (None, "w", other), (8, "z", "y" * 999), (9, "z", "y" * 999), (None, "q", big), (10, "l", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    archives = warc.write(pages, archive_bytes=5000)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(archives).collect())
    winner = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            winner[html] = max(winner.get(html, i), i)
    want = Counter()
    for i, _, html in rows:
        raw, w = (html or "").encode(), winner.get(html)
        revisit = w is not None and i != w
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", w if revisit else None)] += 1
    assert got == want
    names = warc.export(archives, str(tmp_path))
    stored = sum(len(list(warc.unpack((tmp_path / n).read_bytes()))) for n in names)
    assert stored == len(rows)
    fields, _, payload = warc.parse(next(x for n in names for x in warc.unpack((tmp_path / n).read_bytes()) if b"X-Page-Id: 10\r" in x))
    assert payload == b"long " * 400_000 and fields["WARC-Type"] == "response"
    assert warc.read(warc.write(pages.limit(0))).count() == 0


# ---- decontamination


def leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    found = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                found[tuple(w[k : k + window])].add(str(i))
    out = Counter()
    for i, t in docs:
        w, hit, who = words(t), set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in found:
                    hit |= set(range(k, k + size))
                    who |= found[tuple(w[k : k + size])]
        out[(i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))] += 1
    return out


def test_decontamination(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["Ä", "é1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 10, 25])))) for i in range(25)] + [(30, None), (None, "w1 w2"), (3, "w9, w9!")]
    docs = list(ODD)
    for i in range(200):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            t[rng.randint(0, len(t)) :] = (rng.choice(items)[1] or "").split()
        docs.append((100 + i, rng.choice([" ", ", ", "\n"]).join(t).upper() if rng.random() < 0.2 else " ".join(t)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    want = leaks(docs, items)
    for options in ({}, {"block_bytes": 200}):
        got = Counter(tuple(r) for r in decontam.digest(decontam.find(frame(spark, docs), bench, **options)).collect())
        assert got == want
    assert decontam.find(frame(spark, []), bench).count() == 0
    assert decontam.digest(decontam.find(frame(spark, docs), bench.limit(0))).where("contaminated").count() == 0


def test_decontamination_of_equal_shards(spark):
    items = [(i, f"start{i} " + "leak " * 12) for i in range(30)]
    docs = [(i, "x start1 " + "leak " * 12 if i % 12 < 6 else None) for i in range(24)] + [(None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rows in (docs, docs[:6], [(1, None), (2, ""), (3, "...")]):
        for shards in (1, 3):
            spread = frame(spark, rows).repartition(shards * len(rows)) if shards > 1 else frame(spark, rows).coalesce(1)
            found = decontam.find(spread, bench, block_bytes=1000)
            assert Counter(tuple(r) for r in decontam.digest(found).collect()) == leaks(rows, items)


def test_proximity(spark):
    docs = frame(spark, [(1, "one two big three four"), (2, "one x x x two three four"), (3, "one two"), (4, "three four"), (5, "one two three four")])
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    near = {r.doc_id for r in decontam.find(docs, bench, slop=1).collect() if r["items"]}
    exact = {r.doc_id for r in decontam.find(docs, bench).collect() if r["items"]}
    assert exact == {5} and near == {1, 5}


def test_proximity_by_brute_force(spark):
    """Several documents a shard, few words, so that a document's end often hides what the next one begins with."""
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(900, "zzz beta"), (901, "alpha beta")]
    items = [(i, " ".join(rng.sample("abcdef", 2))) for i in range(6)] + [(6, "alpha beta"), (7, "a b c"), (8, "d d"), (9, "c a e b")]
    want = lambda text, item, slop: any(
        all(any(w == word and abs(at - (start + k)) <= slop for at, w in enumerate(text)) for k, word in enumerate(item)) for start in range(-len(item), len(text) + 1)
    )
    before = None
    for slop in range(6):
        found = decontam.find(frame(spark, docs, False), spark.createDataFrame(items, "item_id long, text string"), slop=slop).collect()
        got = {(r.doc_id, i) for r in found for i in r["items"]}
        near = {(d, str(i)) for d, t in docs for i, x in items if want(t.split(), x.split(), slop)}
        # the rarest word is held in place: a match by it is a match, and of two words each can hold the other
        assert got <= near and (before is None or before <= got)
        pairs = {(d, str(i)) for d, t in docs for i, x in items if len(x.split()) == 2 for a, v in enumerate(t.split()) for b, w in enumerate(t.split()) if [v, w] == x.split() and abs(b - a - 1) <= slop}
        assert {(d, i) for d, i in got if len(dict((str(k), x) for k, x in items)[i].split()) == 2} == pairs
        before = got
        if slop == 0:
            assert got == near
    assert (901, "6") in before


# ---- n-gram join


def similar(rows):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows))


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 5, 8, 40, 90]))] for _ in range(20)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base[:2] if rng.random() < 0.4 else base))
        for _ in range(rng.randint(0, max(1, len(t) // 25))):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i * 3 + 1, rng.choice([" ", "\n"]).join(t).upper() if rng.random() < 0.1 else " ".join(t)))
    return rows


@pytest.mark.parametrize("options", [{}, {"often": 3, "block": 7, "fragment_bytes": 4000, "cuts": 3}])
def test_ngram_join(spark, options):
    rows = near_copies(8, 350) + ODD
    got = Counter(tuple(r) for r in ngram_join.join(frame(spark, rows), **options).collect())
    assert got == similar(rows)


def test_ngrams_are_told_apart_by_64_bits(spark):
    # the hashes of these two words have equal low 40 bits
    apart = {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, [(1, "w1017641"), (2, "w1110734"), (3, "w1017641")])).collect()}
    assert apart == {1: 1, 2: 2, 3: 1}
    rng = np.random.default_rng(15)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, (1 << 64) - 1, 1 << 56, (1 << 56) - 1], np.uint64)]))
    for fragments in (1, 3, 255, 256, 300, 1 << 16, 70_001, 1 << 22):
        part = ngram_join.fragment_of(hashes, fragments)
        assert (np.diff(part) >= 0).all() and part[0] == 0 and part[-1] == fragments - 1
        size = ngram_join.token_bytes(fragments)
        for k in np.unique(part)[[0, 1 % len(np.unique(part)), -1]]:
            own = hashes[part == k]
            assert (ngram_join.unpack(ngram_join.pack(own, size), size, int(k), fragments) == own).all()


def test_ngram_join_of_templates(spark):
    """Texts that share a template but less of it than the threshold, some that share enough, and many different sizes."""
    rng = random.Random(16)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    template = say(60)
    rows = [(i, f"{template} {say(rng.choice([2, 9, 14, 15, 16, 20, 25]))}") for i in range(120)]
    got = Counter(tuple(r) for r in ngram_join.join(frame(spark, rows), block=8).collect())
    assert got == similar(rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    assert ngram_join.join(frame(spark, [(1, None), (2, "")])).count() == 2


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}
    top = lambda x: x if parent.setdefault(x, x) == x else top(parent[x])
    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {x: top(x) for x in parent if x != 200}


# ---- suffix arrays


def cut_repeats(rows, length, keep):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    raw = [(t or "").encode() for _, t in rows]
    places = defaultdict(list)
    for i in order:
        for p in range(len(raw[i]) - length + 1):
            places[raw[i][p : p + length]].append((i, p))
    gone = [np.zeros(len(b), bool) for b in raw]
    for at in places.values():
        if len(at) > 1:
            first = [x for x in at if keep == "first" and rows[x[0]] == rows[at[0][0]] and x[1] == at[0][1]]
            for i, p in at:
                if (i, p) not in first:
                    gone[i][p : p + length] = True
    out = Counter()
    for (d, _), b, g in zip(rows, raw, gone):
        left = np.frombuffer(b, np.uint8)[~g].tobytes()
        out[(d, len(b), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest())] += 1
    return out


def repeating(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abécdefgh") for _ in range(rng.randint(10, 250))) for _ in range(6)]
    part = lambda: rng.choice(base)[rng.randint(0, 5) : rng.randint(30, 250)] if rng.random() < 0.6 else "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
    return [(i, "".join(part() for _ in range(rng.randint(0, 4)))) for i in range(90)] + [(300, "ab" * 200), (301, "x" * 500), (302, "x" * 30)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [3, 256])
def test_suffix_dedup(spark, keep, hot):
    rows = repeating(10) + [r for r in ODD if r[0] != 6]
    got = Counter(tuple(r) for r in sa_dedup.digest(frame(spark, rows), length=40, k=16, hot=hot, keep=keep).collect())
    assert got == cut_repeats(rows, 40, keep)


def test_suffix_dedup_texts(spark):
    rows = [(1, "é" * 150 + "end"), (2, "begin" + "é" * 150), (3, None)]
    df = frame(spark, rows).withColumn("kept", F.lit("old"))
    got = {r.doc_id: r for r in sa_dedup.dedup(df, length=100, k=32, keep="first", whole_chars=True).collect()}
    assert bytes(got[3].kept) == b"" and bytes(got[2].kept).decode() == "begin" and got[1].n_bytes == 303
    assert sa_dedup.dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [2048, 4])
def test_suffix_dedup_with_the_settings_of_the_query(spark, keep, hot):
    """Windows of 200 bytes, by the suffix array and (with few runs to a hot gram) by hash; one text is longer than a step."""
    rng = random.Random(20)
    say = lambda n: "".join(rng.choice("abcdefghéü ") for _ in range(n))
    passage, long = say(450), say(sa_dedup.STEP + 3000)
    rows = [(i, say(rng.randint(0, 300)) + passage[rng.randint(0, 150) : rng.randint(300, 450)] + say(rng.randint(0, 300))) for i in range(40)]
    rows += [(100, long), (101, long[1000:1700] + say(50)), (102, say(50) + long[-600:]), (103, "ab" * 300), (104, rows[3][1]), (105, rows[3][1]), (106, None), (107, ""), (None, passage)]
    got = Counter(tuple(r) for r in sa_dedup.digest(frame(spark, rows), hot=hot, keep=keep).collect())
    assert got == cut_repeats(rows, 200, keep)


def test_long_text_in_steps(monkeypatch):
    rng = random.Random(11)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), np.uint8)
    gram, place, first, last = sa_dedup.anchors_of(data, np.array([0, 1200, 1210, 3000]), 40, 16)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert covered.tolist() == [*range(0, 1161), *range(1210, 2961)]
    assert ((first <= place) & (place + 16 <= last + 40)).all()


def test_longest_previous_factors():
    rng = random.Random(12)
    for _ in range(150):
        text, cap = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))), rng.choice([5, 8, 20])
        got, source = sa_dedup.longest_previous(np.frombuffer(text, np.uint8), cap)
        for i in range(len(text)):
            common = lambda j, i=i: next((k for k in range(min(cap, len(text) - i)) if text[i + k] != text[j + k]), min(cap, len(text) - i))
            assert got[i] == max(map(common, range(i)), default=0)
            assert source[i] == -1 or source[i] < i and common(source[i]) == got[i]


def test_repeated_windows_follow_the_factors(monkeypatch):
    rng = random.Random(14)
    calls, real = [], sa_dedup.longest_previous
    monkeypatch.setattr(sa_dedup, "longest_previous", lambda *a: calls.append(a) or real(*a))
    for _ in range(200):
        text, length = bytes(rng.choice(b"ab") for _ in range(rng.randint(13, 120))), rng.choice([8, 9, 13])
        starts = np.array(sorted(rng.sample(range(len(text) - length + 1), min(rng.randint(0, 60), len(text) - length + 1))), np.int64)
        windows = [text[i : i + length] for i in starts]
        earlier, some = sa_dedup.repeated_windows(np.frombuffer(text, np.uint8), starts, length)
        assert earlier.tolist() == [w in windows[:i] for i, w in enumerate(windows)]
        assert some.tolist() == [windows.count(w) > 1 for w in windows]
        factor, _ = real(np.frombuffer(text, np.uint8), length, starts)
        common = lambda a, b: next((k for k in range(len(text) - b) if text[a + k] != text[b + k]), len(text) - b)  # noqa: B023, E731
        assert factor.tolist() == [max((min(length, common(a, b)) for a in starts[:i]), default=0) for i, b in enumerate(starts)]
    assert len(calls) > 50
