import itertools
import time

import numpy as np
import pytest

from quakeframe.llm import html_extract as hx


@pytest.fixture(scope="module")
def field():
    return hx.trained()


def test_blocks():
    texts = lambda page: [b.text for b in hx.blocks_of(page)]
    assert texts("<p>a <b>b</b>c&amp;<br>d<p>e</div>") == ["a bc& d", "e"]
    assert texts("<title>t</title><script>x<p>y</p></script><style>p</style>z<!-- <p>no</p> -->w") == ["zw"]
    assert texts("<ul><li>a<li>b</ul>") == ["a", "b"]
    assert texts("1 < 2 &lt; 3 <p title='>'>x") == ["1 < 2 < 3", "x"]
    assert texts("<head><meta x></head><body>b") == ["b"]
    assert texts("<template><p>no</p></template><p>yes") == ["yes"]
    assert texts(None) == texts("") == texts("<p></p> \n <div>") == []
    assert texts("<p class=\"a") == [] and texts("a<p class='b>c</p>d") == ["a", "c", "d"]
    assert texts("&#233;&eacute;&bogus;&nbsp;x") == ["éé&bogus; x"]
    assert [(b.text, b.path and b.path.name) for b in hx.blocks_of("<h2>a</h3>b")] == [("a", "h2"), ("b", None)]
    (b,) = hx.blocks_of("<nav class='Main-menu topNav' role=navigation><a href=x>link</a> y</nav>")
    assert {"in:nav", *(f"word:{w}" for w in ("main", "menu", "top", "nav", "role-navigation"))} <= set(hx.path_features(b.path)) and b.linked == 4


def test_long_and_broken_pages_are_linear():
    for page in ("<" * 50000, "<p x=\"" * 5000, "<div>" * 3000 + "x", "a" * 10**6, "<!--" * 20000, "</" * 30000, "&" * 100000):
        hx.blocks_of(page)


def test_viterbi_and_gradient_by_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        e, step = rng.normal(size=n), rng.normal(size=(2, 2))
        score = lambda y: sum(e[i] * y[i] for i in range(n)) + sum(step[y[i - 1], y[i]] for i in range(1, n))
        paths = list(itertools.product((0, 1), repeat=n))
        own = hx.Field({}, step.tolist(), 0.0)
        assert tuple(own.viterbi(e.tolist())) == max(paths, key=score)
        labels = np.array([rng.integers(0, 2, n)], float)
        mask = np.ones((1, n), bool)
        value, by_emit, by_step = hx.log_likelihood(e[None], step, labels, mask)
        z = np.log(sum(np.exp(score(y)) for y in paths))
        assert value == pytest.approx(score(tuple(labels[0].astype(int))) - z)
        p = np.array([sum(np.exp(score(y) - z) for y in paths if y[i]) for i in range(n)])
        assert by_emit[0] == pytest.approx(labels[0] - p)
    padded = hx.log_likelihood(np.r_[e, 9.0][None], step, np.c_[labels, 0.0], np.c_[mask, False])
    assert padded[0] == pytest.approx(value) and padded[1][0, :n] == pytest.approx(by_emit[0]) and padded[2] == pytest.approx(by_step)


def test_held_out_pages(field):
    right = total = 0
    for i in range(150):
        blocks, labels = hx.labelled(hx.PageMaker(10**7 + i).page())
        got = field.viterbi(field.emissions(blocks))
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.985


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
<div class="cookie-notice"><p>We use cookies, and more of them.</p><button>OK</button></div>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div id="content"><h1>Big &amp; small</h1><p>First  part of the
story.</p><div class="ad">Buy now</div><p>Caf&eacute; and <b>more</b>.</p></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside>
<form><label>Search</label><input name=q></form>
<div class="comments"><div class="comment"><p>I liked this very much, thank you.</p></div></div>
<footer>&copy; Site</footer></body></html>"""


def test_frames(spark, field):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", PAGE, "y"), (4, "u", "<article>" + "<p>Long text.</p>" * 20000, "x"), (5, "u", "<p>a퟿</p", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    out = sorted(map(tuple, hx.extracted(df, field).collect()), key=lambda r: r[0])
    assert len(out) == 6 and out[0] == out[1]
    assert out[0][2] == "Big & small First part of the story. Café and more." and out[0][3] == len(out[0][2])
    by_id = {r[0]: r for r in out}
    assert by_id[2][1:] == (None, "", 0) and by_id[3][2] == "" and by_id[4][3] == 20000 * 11 - 1
    assert hx.extracted(df.limit(0), field).count() == 0


def test_letters_that_lower_to_two_do_not_end_the_page(field):
    texts = lambda page: [b.text for b in hx.blocks_of(page)]
    for name in hx.RAW_TAGS:
        assert texts(f"<{name}>\u0130<p>no</p></{name.upper()}><p>\u0130stanbul</p>") == ["\u0130stanbul"]
    assert texts("<style>a</\u017ftyle>b</style>c") == ["c"] and texts("a<script>b") == ["a"]
    page = "<html><head><title>T</title></head><body><article><p>" + "One of the towns, which is old, lies on the river. " * 9 + "%s</p></article></body></html>"
    assert field.main_text(page % "\u0130zmir.") == field.main_text(page % "Izmir.").replace("Izmir", "\u0130zmir") != ""


def test_marks_that_end_no_element_and_deep_nesting():
    texts = lambda page: [(b.text, b.linked) for b in hx.blocks_of(page)]
    assert texts("<p>foo<script>x</script>bar<style>y</style> <title>t</title>z</p>") == [("foobar z", 0)]
    assert texts("<p><a href=http://x/>link</a> on</p>") == [("link on", 4)]
    assert texts("<title>\u0130</title><p>Hello there") == [("Hello there", 0)]
    began = time.perf_counter()
    n = 20_000
    behind = hx.blocks_of("<p><button>" + "<b>" * n + "<h1>x" * n)  # a p stays open behind a scope
    assert len(behind) == n and time.perf_counter() - began < 5
    began = time.perf_counter()
    deep = "".join(f'<div class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x">t' for i in range(n)) + "</b>" * n
    blocks = hx.blocks_of(deep)
    assert len(blocks) == n and len(hx.trained().emissions(blocks)) == n
    assert time.perf_counter() - began < 20
    field, few = hx.trained(), hx.blocks_of(deep[:4000])
    for i, b in enumerate(few):
        plain = field.bias + sum(field.weights.get(f, 0.0) for f in hx.path_features(b.path) + hx.text_features(b, i, len(few)))
        assert abs(plain - field.emissions(few)[i]) < 1e-9
