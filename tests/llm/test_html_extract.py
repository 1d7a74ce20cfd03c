from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pytest

from cropwind.llm import html_extract as h
from cropwind.llm import queries

SF = "/root/testdata/sf0.001"
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><h1>My Site</h1><p>Best news of the world. And more.</p></header>
<div id="cookie-notice"><p>We use cookies to make this site better. Please accept them all.</p></div><nav><a href=x>A</a></nav><main><article><h1>Title
 here</h1><p>First <b>para&shy;graph</b>&nbsp; of text &lt;1&gt;, long enough.<br>It has two.<p>Short.<aside><p>Related: other story text. It is long too.</p></aside>
<ul><li>one<li>two</ul><script>var a="<p>no</p>";</script><form><p>Subscribe to our newsletter now. It is free.</p></form><!-- <p>never</p> -->
<div class="ad"><p>Buy this now. It is cheap and very good indeed.</p></div></article><section class="comments"><p>I think this is great. Really, it is.</p></section></main>
<footer><p>Copyright 2020. All rights reserved.</p></footer></body></html>"""
WANT = "Title here\nFirst para­graph of text <1>, long enough. It has two.\nShort.\none\ntwo"


def test_page_without_its_furniture():
    assert h.text_of(PAGE, h.fitted([])) == WANT


def test_marginals_equal_summing_over_all_labellings():
    page = h.parsed("<div class=ad><p>a. b<p>c</div><article><p>long " + "text. " * 30 + "</article>")
    model = h.fitted([])
    model = h.Model(model.weights / 4, model.ties)
    score, n = h.features(page) @ model.weights, len(page.tag)
    total, ones = 0.0, np.zeros(n)
    for x in itertools.product((0, 1), repeat=n):
        e = sum(score[i] * x[i] for i in range(n)) + sum(model.ties[int(h.is_region(page, i)), x[page.parent[i]], x[i]] for i in range(1, n))
        total += math.exp(e)
        ones += math.exp(e) * np.array(x)
    assert h.marginals(page, model) == pytest.approx((ones / total).tolist(), abs=1e-9)


def article(source):
    """What stands in the article, read by patterns that fit the generated pages only."""
    body = re.search(r"<article>(.*)</article>", source, re.S)[1]
    import html

    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_query_over_the_whole_table(spark):
    want = {r.page_id: article(r.html) for r in queries.table(spark, SF, "pages").collect()}
    out = queries.op10_html_extract(spark, SF).collect()
    assert {r.page_id: r.text for r in out} == want and len(out) == len(want)
    assert all(r.n_chars == len(r.text) for r in out)


def test_held_out_pages_follow_their_documents(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    pages = [(r.html, texts.get(int(re.search(r"/(\d+)", r.url.split("//")[1])[1]))) for r in queries.table(spark, SF, "pages").orderBy("page_id").collect()]
    pages = [p for p in pages if p[1] is not None]
    model, right, all_ = h.fitted(pages[::2]), 0, 0
    for source, document in pages[1::2]:
        page = h.parsed(source)
        y, share = h.labelled_nodes(page, document)
        if share >= h.MIN_LABELLED:
            p = np.array(h.marginals(page, model))
            right += int(((p >= 0.5) == (y == 1))[y >= 0].sum())
            all_ += int((y >= 0).sum())
    assert all_ and right / all_ >= 0.95


def test_null_empty_broken_and_clashing_rows(spark):
    rows = [(1, None, None, 7), (1, "u", "", 8), (None, "u", "<p>open <b>text", 9), (2, "u", "</div></p>plain & simple<<", 1), (3, "u", "<" * 5000, 1), (4, "u", "<div>" * 20000 + "deep text", 1), (5, "u", "<p a='" + "x" * 1000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = h.extract(df, h.fitted([])).collect()
    assert len(out) == len(rows) and h.extract(df.where("false"), h.fitted([])).count() == 0
    found = {r.page_id: r.text for r in out}
    assert found[None] == "open text" and found[2].startswith("plain & simple") and found[4] == "deep text" and sorted(r.text for r in out if r.page_id == 1) == ["", ""]


def test_what_no_furniture_holds_is_kept():
    model = h.fitted([])
    for source, want in [
        ("<div>plain text of some length here.</div>", "plain text of some length here."),
        ("<article><p>One. Two.</p><div class='reviews-of-literature'><p>A study of studies.</p></div></article>", "One. Two.\nA study of studies."),
        ("<div id='site-content'><p>Alert readers skip the bar.</p><ul class='tags'><li>one</li></ul></div>", "Alert readers skip the bar.\none"),
        ("<nav><ul><li><a href=x>Home</a></ul></nav><div><span>Text.</span></div><footer>Foot</footer>", "Text."),
    ]:
        assert h.text_of(source, model) == want
