import html
import itertools
import random
import re

import numpy as np
import pytest

from ebbtide.llm import html_main
from ebbtide.llm.html_blocks import blocks
from ebbtide.llm.queries import QUERIES


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_forgiving_html():
    assert texts("<p>a <b>b</b>\n c<br>d<p>e&amp;f &lt;g&gt; &#233;&nbsp;h") == ["a b c d", "e&f <g> é h"]
    assert texts('<script>var t="</p>";if(a<b)x()</script>t<style>p{}</style>u') == ["tu"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("a<!-- <p>no</p> -->b<!-->c<!DOCTYPE x>d<?php e ?>f") == ["abcdf"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts('<p title="a > b" class=x>t</p 1 < 2 <3') == ["t"]
    assert texts("1 < 2 and 3 <4> 5 & 6") == ["1 < 2 and 3 <4> 5 & 6"]
    assert texts("<p>cut in a tag <div cla") == ["cut in a tag"]
    assert texts("<script>never ends <p>a</p>") == []
    assert texts("<textarea>a</textarea><title>b</title>c") == ["c"]
    assert texts(None) == texts("") == texts(" \n ") == []
    assert texts("</p></div>a</body>") == ["a"]


def test_paths_links_and_marks():
    page = blocks('<div class="Main-Col x" id=wide><p>a <a href=q>link</a></p></div><p>b')
    assert [f.tag for f in page[0].path] == ["div", "p"]
    assert page[0].path[0].tokens == ("main", "col", "x", "wide") and page[0].linked == 4
    assert [f.tag for f in page[1].path] == ["p"] and page[1].linked == 0


def brute(emission, start, step):
    n = len(emission)
    scores = {y: start[y[0]] + sum(e * a for e, a in zip(emission, y))
              + sum(step[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
    return scores


def test_field_equals_enumeration():
    draw = np.random.default_rng(3)
    start, step = draw.normal(size=2), draw.normal(size=(2, 2))
    lengths = [1, 4, 6]
    emission, truth = draw.normal(size=(3, 6)), draw.integers(0, 2, (3, 6))
    real = np.arange(6) < np.array(lengths)[:, None]
    truth = truth * real

    def value(e, s, t):
        return sum(brute(e[i, :n], s, t)[tuple(truth[i, :n])]
                   - np.log(sum(np.exp(x) for x in brute(e[i, :n], s, t).values()))
                   for i, n in enumerate(lengths))

    got, by_block, by_start, by_step = html_main.likelihood(emission, truth, real, start, step)
    assert got == pytest.approx(value(emission, start, step))
    for where, gradient in ((emission, by_block), (start, by_start), (step, by_step)):
        for at in np.ndindex(where.shape):
            args = [emission.copy(), start.copy(), step.copy()]
            target = next(a for a, b in zip(args, (emission, start, step)) if b is where)
            target[at] += 1e-5
            slope = (value(*args) - got) / 1e-5
            assert slope == pytest.approx(gradient[at], abs=1e-3)
    field = html_main.Field(np.zeros(1), start, step)
    for i, n in enumerate(lengths):
        best = max(brute(emission[i, :n], start, step).items(), key=lambda x: x[1])[0]
        assert tuple(html_main.decode(field, emission[i, :n].tolist())) == best


@pytest.fixture(scope="module")
def field(spark, folder):
    return html_main.fit(spark.read.parquet(f"{folder}/pages.parquet"))


def test_unseen_layouts(field):
    draw = random.Random(1)
    some = [" ".join(draw.choices(["lorem", "ipsum,", "dolor", "sit", "amet", "Et", "in"], k=150))]
    right = total = exact = 0
    for page in map(blocks, html_main.labelled_pages(some, 150, seed=77)):
        truth = html_main.labels(page).tolist()
        found = html_main.decode(field, html_main._emissions(
            field.weights, html_main.features(page)).tolist())
        right += sum(a == b for a, b in zip(truth, found))
        total += len(truth)
        exact += truth == found
    assert right >= 0.98 * total and exact >= 0.8 * 150


def test_a_written_page(field):
    page = """<!doctype html><html><head><title>T</title><script>x('<p>')</script></head><body>
    <div class="cookie-banner" role=dialog><p>We use cookies, many of them.</p><button>OK</button></div>
    <header class="site-header"><div class="logo">The Site</div></header>
    <nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>
    <main><article><h1>A day &amp; a night</h1>
    <p>It rained, and it rained, and the river rose
       over the old stones of the bridge.</p><div class="ad">Buy boots now.</div>
    <p>In the morning the sun came out again, and people came to look.</article></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/b>More rain</a></ul></aside>
    <form class="newsletter"><p>Get our letter.</p><input><button>Sign up</button></form>
    <section id="comments" class="comments"><h3>Comments</h3><div class="comment"><p>I was there too,
    and it was a sight to see, really, for everyone of us.</p></div></section>
    <footer>&copy; The Site, all rights reserved.</footer></body></html>"""
    assert html_main.main_text(field, page) == (
        "A day & a night\n\nIt rained, and it rained, and the river rose over the old stones of the "
        "bridge.\n\nIn the morning the sun came out again, and people came to look.")


def test_query_equals_what_the_pages_say(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op4_main_text"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split())
                 for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_odd_pages_and_no_pages(spark, field):
    rows = [(1, "u", None), (None, None, ""), (2, "v", "<p>" * 3000 + "x"), (3, "w", "plain"),
            (4, "x", "<article>" + "<p>many words in a paragraph here " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 AS text", "2 AS n_chars")
    found = html_main.extracted(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    by_id = {r.page_id: r for r in found.collect()}
    assert by_id[1].text == by_id[None].text == "" and by_id[1].n_chars == 0
    assert by_id[4].text.count("\n\n") == 19_999
    assert html_main.extracted(pages.where("false")).count() == 0
