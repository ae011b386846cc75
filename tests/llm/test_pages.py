"""Main text of pages: parser, field and whole query against plain versions."""

import itertools

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import pages
from lodestat.llm.queries import QUERIES


@pytest.fixture(scope="module")
def field(spark, data):
    return pages.train(spark.read.parquet(f"{data}/pages.parquet"))


def test_query_equals_the_articles(spark, data):
    want = {r.page_id: (r.url, brute.article(r.html)) for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, data).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_blocks():
    def of(source):
        return [b.text for b in pages.blocks(source)]

    assert of(None) == of("") == of("<p> <br> </p>") == of("<!-- only a comment") == of("<script>x") == []
    assert of("plain &lt;text&gt;\n here") == ["plain <text> here"]
    assert of('<p>a <b>b</b>c<a href="x>y">d</a><br>e<p>f') == ["a bcd e", "f"]
    assert of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert of("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert of('<SCRIPT>if (a<b) "</p>"</Script>x<style>p{}</style><!-- <p>no</p> -->y') == ["xy"]
    assert of("a < b &amp&am; &#233;&eacute;\xa0z 5 > 4") == ["a < b &&am; éé z 5 > 4"]
    assert of("<div>a<div>b</div>c</div></div></p>d<p") == ["a", "b", "c", "d"]
    assert of("<p>" + "é word " * 300_000 + "</p>") == [" ".join(["é word"] * 300_000)]
    assert len(pages.blocks("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1
    assert of('<p class="a>b') == ["b"]
    path = pages.blocks("<article><p>a<b>b<div>c</div></article><footer>d</footer>")
    assert [b.path for b in path] == [("article", "p"), ("article", "div"), ("footer",)]


def test_gradient_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(3)
    field = pages.BlockField(np.zeros(pages.SLOTS), 0.3, rng.normal(size=(2, 2)))
    field.weights[:20] = rng.normal(size=20)
    page = [pages.Block("", sorted(rng.choice(20, 4, replace=False).tolist()), ()) for _ in range(6)]
    e = field.emissions(page)
    assert np.allclose(e, [field.weights[b.features].sum() + 0.3 for b in page])

    def value(y):
        return sum(e[k] * y[k] for k in range(6)) + sum(field.moves[a, b] for a, b in itertools.pairwise(y))

    every = list(itertools.product((0, 1), repeat=6))
    assert field.decode(page).astype(int).tolist() == list(max(every, key=value))
    labels = np.array([[0, 1, 1, 0, 1, 1], [1, 0, 0, 0, 0, 0]], float)
    used = np.array([[True] * 6, [True] * 4 + [False] * 2])
    flat = np.array([f for _ in range(2) for b in page for f in b.features])
    cell = np.repeat(np.arange(12), 4)
    keep = used.ravel()[cell]
    flat, cell = flat[keep], cell[keep]
    got, g_w, g_b, g_m = pages.log_likelihood(field, flat, cell, labels, used)
    assert np.isclose(got, sum(value(labels[0].astype(int)) for _ in range(1)) - np.log(sum(np.exp(value(y)) for y in every)) + _short(e, field, labels[1, :4].astype(int)))
    for change, gradient in ((("w", 3), g_w[3]), (("b",), g_b), (("m", 0, 1), g_m[0, 1]), (("m", 1, 1), g_m[1, 1])):
        sides = []
        for step in (1e-6, -1e-6):
            near = pages.BlockField(field.weights.copy(), field.bias, field.moves.copy())
            if change[0] == "w":
                near.weights[change[1]] += step
            elif change[0] == "b":
                near.bias += step
            else:
                near.moves[change[1:]] += step
            sides.append(pages.log_likelihood(near, flat, cell, labels, used)[0])
        assert np.isclose((sides[0] - sides[1]) / 2e-6, gradient, atol=1e-5)


def _short(e, field, y):
    def value(z):
        return sum(e[k] * z[k] for k in range(4)) + sum(field.moves[a, b] for a, b in itertools.pairwise(z))

    return value(y) - np.log(sum(np.exp(value(z)) for z in itertools.product((0, 1), repeat=4)))


def test_field_on_layouts_it_was_not_fitted_on(spark, data, field):
    texts, heads, shorts = [], [], []
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        page = pages.blocks(r.html)
        for b, label in zip(page, pages.marked(page), strict=True):
            (shorts if not label else texts if len(b.text) > 60 else heads).append(b.text)
    right = total = 0
    for seed in range(300):
        page, labels = pages.arranged(texts, heads, shorts, seed)
        right += (field.decode(page) == np.array(labels, bool)).sum()
        total += len(labels)
    assert right / total > 0.98


PROSE = "It was a long winter, and the people of the town had begun to wonder whether the thaw would ever arrive at all."


@pytest.mark.parametrize(
    "around",
    [
        '<nav class="main-nav"><a href="/">Home</a> <a href="/n">News</a></nav>{}<footer>© 2023 Someone</footer>',
        '<header id="site-header"><p>The Site</p></header>{}<aside class="sidebar-widget"><p>Popular posts</p><p>' + PROSE + "</p></aside>",
        '<div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>OK</button></div>{}<div id="comments"><p>' + PROSE + "</p><p>I agree with this.</p></div>",
        '<form class="search-form"><label>Search</label><input></form>{}<section class="user-comments"><div class="comment"><p>' + PROSE + "</p></div></section>",
        '<div class="ad-slot"><a href="#">Buy now</a></div>{}<div class="newsletter-signup"><p>Subscribe to our newsletter.</p></div><script>x("<p>no</p>")</script>',
    ],
)
@pytest.mark.parametrize("opening", ["<article>", "<main>", '<div class="post-content">', '<div id="article-body">'])
def test_written_pages(field, around, opening):
    body = f"{opening}<h1>A title</h1><p>{PROSE}</p><p>{PROSE} &amp; <i>more</i>.</p>{pages._end_of(opening)}"
    assert pages.main_text(f"<html><head><title>t</title></head><body>{around.format(body)}</body></html>", field) == f"A title\n{PROSE}\n{PROSE} & more."


def test_edges(spark, field):
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(1, None), (2, ""), (3, "<p></p>"), (4, f"<article><p>{PROSE}</p></article>"), (4, f"<article><p>{PROSE}</p></article>"), (None, f"<main>{PROSE}</main>"), (5, long)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit(7), "n_chars": F.lit("x"), "path": F.lit("y")})
    got = sorted(((r.page_id or -1, r.text, r.n_chars, r.path) for r in pages.extract(df, field).collect()), key=str)
    want = [(1, ""), (2, ""), (3, ""), (4, PROSE), (4, PROSE), (-1, PROSE), (5, "\n".join([PROSE] * 20_000))]
    assert got == sorted(((i, t, len(t), "y") for i, t in want), key=str)
    none = df.where("false")
    assert pages.extract(none, pages.train(none)).count() == 0
    bare = pages.train(spark.createDataFrame([(1, "<p>no marks</p>"), (2, None)], "page_id long, html string"))
    assert pages.main_text(f"<nav><a>Home</a></nav><article><p>{PROSE}</p></article>", bare) == PROSE
