import itertools
import random

import numpy as np

from quantloom.llm import html_extract as H


def keep_all(source):
    page = H.Page(source)
    return page.text([True] * len(page.parents))


def test_parsing_and_text():
    assert keep_all("<p>a &amp; b&nbsp; c\n d<br>e<p>f <b>g</b>h</p> i") == "a & b c d e\nf gh\ni"
    assert keep_all('x<script>var t="</p>";if(a<b){}</script >y<style>p{}</style><!-- <p>no</p> -->z') == "xyz"
    assert keep_all("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == "1\n2\n3\n4"
    assert keep_all("<table><tr><td>a<td>b<tr><th>c</table>") == "a\nb\nc"
    assert keep_all("a < b, 1<2 &#233;&#x1F642;&lt;p&gt;&bogus; &am") == "a < b, 1<2 é🙂<p>&bogus; &am"
    assert keep_all("<div title='<p>\">'>in</div><a href=x>l</a") == "in\nl"
    assert keep_all("ok<script>never closed <p>x</p>") == "ok"
    assert keep_all("<![CDATA[a &amp; <b>]]>") == "a &amp; <b>"
    assert keep_all("İ<SCRIPT>x</sCript>y<p") == "İy"
    assert keep_all("<p><b>one<br><p>two</article></nosuch>") == "one\ntwo"
    assert keep_all("<div>" * 2000 + "deep") == "deep"
    assert keep_all("") == keep_all("<p> </p>") == ""


def test_hostile_pages_are_linear():
    for bad in ("<a '", '<a "', "<", "<!--", "<script>", "&", "<p <p ", "</"):
        keep_all(bad * 30_000)
    n = 30_000
    for bad in ("<i>" * n + "<li></li>" * n, "<a><div>" + "<i>" * n + "</a>" * n, "<div>" * n + "</p>" * n + "<p>" * n, "<div>" * n + "</span>" * n):
        keep_all(bad)


def test_no_depth_loses_text():
    model = H.trained()
    around = lambda d: PAGE.replace("<article>", "<div>" * d + "<article>").replace("</article>", "</article>" + "</div>" * d)
    within = lambda d: PAGE.replace("<p>Yes.</p>", "<div>" * d + "<p>Yes, and more words of it here.</p>" + "</div>" * d + "<p>And so it ends, in these words.</p>")
    for page in (around, within):
        want = H.texts_of([page(0)], model)
        assert "Yes" in want[0] and "cookies" not in want[0]
        for depth in (1, 10, 299, 310, 5000):
            assert H.texts_of([page(depth)], model) == want


def test_marginals_as_by_brute_force():
    rng = np.random.default_rng(0)
    for seed in range(6):
        pages = [H.Page(H.labelled_page(random.Random(seed))) for _ in range(1)]
        page = pages[0]
        n = min(11, len(page.parents))
        page.parents, page.features, page.kinds, page.labels, page.links = (x[:n] for x in (page.parents, page.features, page.kinds, page.labels, page.links))
        page.pieces = [x for x in page.pieces if x[0] < n]
        forest = H.Forest([page, page])
        unary, pair = rng.normal(size=2 * n), rng.normal(size=(H.KINDS, 2, 2))
        one, inner, joint, log_z = H.marginals(forest, unary, pair)
        want_log_z = 0
        for off in (0, n):
            weights, states = [], list(itertools.product((0, 1), repeat=n))
            for s in states:
                e = sum(unary[off + i] * s[i] for i in range(n))
                e += sum(pair[page.kinds[i], s[page.parents[i]], s[i]] for i in range(1, n))
                weights.append(np.exp(e))
            weights = np.array(weights)
            want_log_z += np.log(weights.sum())
            states = np.array(states)
            assert np.allclose(one[off : off + n], (weights[:, None] * states).sum(axis=0) / weights.sum())
            for i in range(1, n):
                j = int(np.flatnonzero(inner == off + i)[0])
                for a, b in itertools.product((0, 1), repeat=2):
                    hit = (states[:, page.parents[i]] == a) & (states[:, i] == b)
                    assert np.isclose(joint[j, a, b], weights[hit].sum() / weights.sum())
        assert np.isclose(log_z, want_log_z)


def test_held_out_pages():
    rng, exact, elements, right = random.Random(12345), 0, 0, 0
    model = H.trained()
    for _ in range(120):
        page = H.Page(H.labelled_page(rng))
        forest = H.Forest([page])
        keep = H.marginals(forest, forest.x @ model[0], model[1])[0] >= 0.5
        labels = np.array([-1 if x is None else x for x in page.labels])
        elements += (labels >= 0).sum()
        right += (keep == labels)[labels >= 0].sum()
        exact += page.text(keep) == page.text(labels == 1)
    assert right >= 0.985 * elements and exact >= 0.75 * 120


PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy now, it is cheap. Really.</div><article><h1>Head &amp; line</h1><p>First <a href="x">linked</a>
 words, and more of them here.</p><p>Yes.</p></article><aside class="sidebar"><h3>Related</h3><p>Some other story, told elsewhere.</p></aside>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I like this, it is very good.</p></div></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_pages_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (None, "u", "<p>Only a paragraph, with some words in it.</p>"), (4, "u", "<article><p>" + "Words, and more words. " * 20_000 + "</p></article>")]
    out = H.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert got[1].text == "Head & line\nFirst linked words, and more of them here.\nYes."
    assert got[2].text == got[3].text == "" and got[None].text.startswith("Only") and got[4].n_chars == 23 * 20_000 - 1
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
