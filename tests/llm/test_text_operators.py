"""Fill-in-middle, branch merge and HTML text against brute force and planted cases."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnwell.llm import branch_merge, fim, html_text, queries

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "word"), (5, "a<M>b"), (6, "lang \n" * 30_000), (7, "same text"), (7, "same text"), (None, "no id"), (None, None), (8, "İΣς ﷺ é   \U0001f600\U0001f600x"), (9, "\u0001\u0002\u0003\u0004\u0002\u0001" * 20), (-5, "base"), (10, "\n")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, extra=True):
    """doc_id, text, lang, source and columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit("s")})
    return df.withColumns({c: F.lit(1) for c in ("n", "form", "prefix", "_cut", "left", "right", "_l", "present", "n_clean", "l", "r")}) if extra else df


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


# ---- fill-in-middle


def fim_by_hand(doc_id, text, seed="1"):
    text = text or ""
    n, h = len(text), sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, a, b - a, sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text)


def test_fim_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = [fim_by_hand(r.doc_id, r.text) for r in docs.collect()]
    assert ordered(queries.op11_fim(spark, DATA).collect()) == ordered(want)


def test_fim_odd_rows(spark):
    rows = ODD + [(100 + i, "ab\u0001c\U0001f600\u0002\u0003<P"[: i % 9]) for i in range(60)]
    got = fim.digest(fim.transform(frame(spark, rows))).collect()
    assert ordered(got) == ordered(fim_by_hand(i, t) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transform(frame(spark, []))).count() == 0


def test_fim_by_words(spark):
    """Units of words: every part begins at a word, what stands before the first stays in front, and all text comes back."""
    rows = [(i, "  one two\nthree  four " + "x" * (i % 3)) for i in range(200)]
    got = fim.transform(frame(spark, rows, False), unit=r"\S+\s*", rate=100)
    got = got.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == r.text == r.prefix + r.middle + r.suffix and r.n == len(r.text.split()) for r in got)
    assert all(part[:1] in "otfx" for r in got for part in (r.middle, r.suffix) if part and r.prefix)


# ---- three-way merge


def merge_by_hand(rows):
    """Rows (doc_id, text, lang, source), each merged by itself; added rows by id."""
    out, added = [], defaultdict(lambda: defaultdict(list))
    code = lambda b, i, n: zlib.crc32(f"{b}:{'' if i is None else i}:{n}".encode()) % 17
    mark = {1: "!", 2: "?"}
    for i, text, *values in rows:
        lines, values = (text or "").split("\n"), [v or "" for v in values]
        drops, columns, edits, gaps = {}, {}, {}, {}
        for b in "LR":
            edit = lambda v, k, gone: gone if k == 0 else v + mark.get(k, "")
            columns[b] = [edit(v, code(b, i, n), "") for n, v in zip(("lang", "source"), values)]
            edits[b] = [edit(x, code(b, i, j), None) for j, x in enumerate(lines)]
            gaps[b] = [{3: "!", 4: "?"}.get(code(b, i, j)) for j in range(len(lines))]
            drops[b] = code(b, i, "row") == 0
            if code(b, i, "row") in (3, 4):
                added[None if i is None else {"L": -1, "R": -5}[b] - i][b].append((*values, {3: "!", 4: "?"}[code(b, i, "row")]))
        changed = {b: columns[b] != values or edits[b] != lines or any(gaps[b]) for b in "LR"}
        counts = dict.fromkeys(("clean", "edit", "delete", "insert"), 0)

        def join(base, x, y, clash):
            if x == y or x == base or y == base:
                counts["clean"] += (x, y) != (base, base)
                return y if x == base else x
            counts[clash(x, y)] += 1
            return x

        if drops["L"] or drops["R"]:
            other = changed["R"] if drops["L"] else changed["L"]
            fights = other and not (drops["L"] and drops["R"])
            counts["delete" if fights else "clean"] = 1
            state = (columns["L"], edits["L"], gaps["L"]) if fights and not drops["L"] else None
        else:
            state = (
                [join(v, x, y, lambda x, y: "edit") for v, x, y in zip(values, columns["L"], columns["R"])],
                [join(v, x, y, lambda x, y: "delete" if None in (x, y) else "edit") for v, x, y in zip(lines, edits["L"], edits["R"])],
                [join(None, x, y, lambda x, y: "insert") for x, y in zip(gaps["L"], gaps["R"])],
            )
        shown = [*state[0], sha("\n".join(x for pair in zip(*state[1:]) for x in pair if x is not None))] if state else [None] * 3
        out.append((i, *shown, *counts.values()))
    for i, sides in added.items():
        left, right = (min(sides[b]) if sides[b] else None for b in "LR")
        clash = int(bool(left and right and left != right))
        lang, source, text = left or right
        out.append((i, lang, source, sha(text), 1 - clash, 0, 0, clash))
    return out


def test_merge_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = merge_by_hand([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    assert all(sum(r[k] for r in want) for k in (4, 5, 6, 7))
    assert ordered(queries.op12_branch_merge(spark, DATA).collect()) == ordered(want)


def test_merge_odd_rows(spark):
    rows = ODD + [(1000 + i, "a\n\nb"[: i % 5]) for i in range(800)]
    df = frame(spark, rows)
    want = merge_by_hand([(r.doc_id, r.text, r.lang, r.source) for r in df.collect()])
    assert ordered(branch_merge.digest(branch_merge.merge_coded(df)).collect()) == ordered(want)
    assert branch_merge.digest(branch_merge.merge_coded(frame(spark, []))).count() == 0


def test_merge_of_given_scripts(spark):
    """Branches that the caller writes: texts, conflicts of each kind, inserts of several lines, a gap that outlives its line."""
    rows = spark.createDataFrame([(1, "en", "a\nb\nc\nd")], "doc_id long, lang string, text string")
    s = branch_merge.step
    left = F.struct(F.lit(False).alias("drop"), F.lit("fr").alias("lang"), F.array(s("replace", F.lit("A")), s("delete"), s("retain", None, F.lit("x\ny")), s("retain", None, F.lit("p"))).alias("script"))
    right = F.struct(F.lit(False).alias("drop"), F.lit("fr").alias("lang"), F.array(s("replace", F.lit("B")), s("replace", F.lit("b!"), F.lit("gap")), s("delete"), s("retain", None, F.lit("q"))).alias("script"))
    got = branch_merge.merge_rows(rows.select("*", left.alias("left"), right.alias("right")), "doc_id", ["lang"], "text").first()
    assert (got.text, got.lang) == ("A\ngap\nx\ny\nd\np", "fr")
    # clean: lang, the gap, x and y, the drop of c; conflicts: a, b, the last gap
    assert [got[c] for c in branch_merge.COUNTS] == [4, 1, 1, 1]


def test_merge_has_no_single_task(spark):
    """Base rows are not shuffled; added ones are, by id."""
    plan = queries.op12_branch_merge(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Broadcast" not in plan
    assert len(set(re.findall(r"Exchange (\w+)", plan))) == 1 and "hashpartitioning(doc_id" in plan


# ---- HTML text


def test_minimum_cut_by_brute_force():
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randint(1, 8)
        odds = [rng.randint(-5, 5) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 4)) for _ in range(rng.randint(0, 14))]
        cost = lambda kept: sum(o * (o > 0 and not k) - o * (o < 0 and k) for o, k in zip(odds, kept)) + sum(c for a, b, c in edges if kept[a] != kept[b])
        assert cost(html_text.minimum_cut(odds, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_html_of_the_table(spark):
    """The pages have one article each; its paragraphs are cut out by a pattern here."""

    def by_hand(page):
        inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        return "\n".join(x for x in parts if x)

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op13_html_text(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, by_hand(pages[r.page_id].html), len(r.text))


FULL = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><h1>Site</h1><p>Welcome to this site, the best of all sites there are.</p></header>
<nav><a href=x>Home</a> <a href='y>z'>News</a></nav><div class="cookie-banner"><p>We use cookies to make this site better for all of you, so accept them please.</p></div>
<form id=f><main><div class="wrap"><article class="post"><header><h1>The title &amp; more</h1><p class="byline">By Ann</p></header><p>First \t  paragraph with<br>a break &lt;b&gt; and &eacute;&nbsp;x.<!-- <p>no</p> --><p>Second <i>one</i>, s<b>hor</b>t.
<div class="ad-slot"><p>Buy our great things now, they are the best things that were ever made by anyone in the world.</p></div><ul><li>Item one<li>Item two</ul><table><tr><td>cell</td></tr></table><p hidden>Not to be seen by anyone who reads this page.</p>
<p>Text <span style="display:none">unseen</span>goes on.</p><section id="comments"><article class="comment"><p>A reader says that this is a very long comment which reads like an article, really.</p></article></section><footer>Filed under things</footer></article></div></main></form>
<aside><p>Related: a long text that looks like a paragraph of an article, but it is not one of them.</p></aside><footer><p>&copy; 2024</p></footer><script>if(a<b) document.write("<p>no</p>")</script></body></html>"""
SOUP = """<div id=top><a href=1>Home</a> | <a href=2>About us</a></div><div><div><h2>Heading here</h2><div>This is a long piece of text that makes the first paragraph of the story, and it ends here.</div><div>Short one.</div>
<div>Another long piece of text that makes the third paragraph of the story, and it ends here.</div></div><div><a href=x>More</a></div></div><div>Copyright 2024 by us. All rights reserved.</div>"""


def test_html_parts():
    assert html_text.main_text(FULL).split("\n") == ["The title & more", "First paragraph with a break <b> and é x.", "Second one, short.", "Item one", "Item two", "cell", "Text goes on."]
    # without any hint, the cut keeps the short block between long ones and the heading before them
    kept = html_text.main_text(SOUP).split("\n")
    assert kept[0] == "Heading here" and kept[2] == "Short one." and len(kept) == 4


def test_html_smoothness_matters():
    alone = html_text.Costs(adjacent=0, sibling=0, cousin=0)
    assert "Short one." not in html_text.main_text(SOUP, alone)


@pytest.mark.parametrize("broken", ["", None, "<", "<p", "</", "<!--", "<!-- x", "<p class='", "&", "&#xD800;", "</div></p>", "<script>", "<article><p>", "<a href=\"x>y", "\x00", "<p>" * 50_000, "<div>" * 50_000 + "x", "<b" * 20_000, "<p title=\"" * 5_000, "plain text. " * 100_000])
def test_html_broken(broken):
    text = html_text.main_text(broken)
    assert "<p" not in text and text == text.strip()


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<article><p>One.</article>"), (3, "u", "<article><p>Same.</article>"), (3, "u", "<article><p>Same.</article>"), (4, "u", "<article>" + "<p>word</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(7), "n_chars": F.lit("x")})
    got = {(r.page_id, r.text[:20], r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "One.", 4), (3, "Same.", 5), (4, "word\nword\nword\nword\n", 99_999)}
    assert html_text.extract(pages).count() == 6 and html_text.extract(pages.limit(0)).count() == 0
