import itertools
import time

import numpy as np
import pytest

from lignum.llm import html_text as h


def test_marginals_are_exact():
    """Against the sum over all labellings of a small forest."""
    pages = ["<body><article><p>a b c</p><p>d</p></article><nav>x<ul><li>y</ul></nav>", "<p>lone", ""]
    forest = h.Forest([h.Tree(p) for p in pages])
    draw = np.random.default_rng(1)
    w, e = draw.normal(size=h.N_FEATURES), draw.normal(size=(2, 2))
    n = len(forest.parent)
    score = forest.scores(w)
    single, pair, z = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(score[i] * y[i] + (e[y[forest.parent[i]], y[i]] if forest.parent[i] >= 0 else 0) for i in range(n)))
        z += p
        for i in range(n):
            single[i, y[i]] += p
            if forest.parent[i] >= 0:
                pair[i, y[forest.parent[i]], y[i]] += p
    got = forest.marginals(w, e)
    assert np.allclose(got[0], single / z) and np.allclose(got[1], pair / z) and np.isclose(got[2], np.log(z))


def test_held_out_pages():
    w, e = h.default_model()
    trees = [h.Tree(p) for p in h.labelled_pages(120, seed=77)]
    keep = h.Forest(trees)
    single = keep.marginals(w, e)[0][:, 1] > 0.5
    right = total = 0
    for t, first in zip(trees, keep.first, strict=False):
        own = t.made_labels()
        for b, text, _ in t.blocks():
            right += len(text) * (own[b] == single[first + b])
            total += len(text)
    assert right / total > 0.95


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></li><li><a href=/b>Items</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>The  title &amp; more</h1><p><b>One&nbsp;line,<br>next   line &#233;&hellip;<br><p>Second <a href=x>linked</a> paragraph
goes on.</p></article><section class="comments"><p>I liked it a lot, thanks.</p></section>
<form><p>Your name please.</p><input></form><footer>&copy; 2024 Some words of the footer.</footer></body></html>"""


def test_page(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "<nav>" * 3000 + "x"), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text")
    got = h.extract(df).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[1].text == "The title & more\nOne line, next line é…\nSecond linked paragraph goes on."
    assert (by[2].text, by[3].text, by[4].text) == ("", "", "")
    assert h.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<", "</", "<!--", "<a", "&#", "&#xFFFFFFFF;", "<script>", "</p></div>", "<table><tr><td>a<td>b<tr><td>c</table>", "<p" * 500, "\0", "<![CDATA[x]]>"])
def test_broken_pages(html):
    h.main_text([html], *h.default_model())


def test_articles_of_the_tables(spark, sf):
    """The pages of the tables keep their article in one element."""
    import html
    import re

    rows = h.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    same = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div)>", inner)]
        same += "\n".join(x for x in parts if x) == r.text
    assert same >= 0.98 * len(rows)
    assert all(r.text for r in rows)


def test_labels_of_found_pages():
    tree = h.Tree("<body><nav>a</nav><main><header>b</header><p>c</p><div class='ad'><p>d</p></div><section><p>e</p></section></main><p>f</p>")
    labels = tree.found_labels()
    assert [text for b, text, _ in tree.blocks() if labels[b]] == ["c", "e"]
    assert h.Tree("<p>x</p>").found_labels() is None
    assert h.Tree("<main>x</main><main>y</main>").found_labels() is None


PROSE = "The river rose in the night, and by morning the lower fields were under water. Nobody had seen it so high before."
LAYOUTS = {  # unlike the tables; made layouts and features were chosen with these in view
    "plain": f"<h1>Flood</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p>",
    "one block": f"<html><body><p>{PROSE} {PROSE}</p></body></html>",
    "cells": f"<table border=0><tbody><tr><td width=90><a href=1>Home</a><br><a href=2>News</a></td><td><center><h2>Flood</h2></center><p>{PROSE}<p>{PROSE}</td></tr></tbody></table>",
    "grid": f"<div class='row'><div class='col-8'><h2>Flood</h2><p>{PROSE}</p><p>{PROSE}</p></div><div class='col-4'><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div></div>",
    "nested": f"<div><div><div><div><div>{PROSE}</div><div>{PROSE}</div></div></div></div></div>",
    "columns": f"<section><section><p>{PROSE}</p><dl><dt>Depth</dt><dd>{PROSE}</dd></dl></section></section>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_foreign_layouts(layout):
    text = h.main_text([LAYOUTS[layout]], *h.default_model())[0]
    assert text.count(PROSE) == LAYOUTS[layout].count(PROSE)
    assert "Home" not in text and "News" not in text


def test_deep_pages_take_linear_time():
    began = time.time()
    assert h.main_text(["<div>" * 100_000 + PROSE], *h.default_model()) in ([PROSE], [""])
    assert time.time() - began < 10
