"""HTML extraction: blocks, the field against brute force, unseen layouts, the given pages, and odd inputs."""

import time
from html.parser import HTMLParser
from itertools import product

import numpy as np
import pytest

from kvlake.llm import html_text, queries
from kvlake.llm.html_blocks import MAIN, NAMES, blocks, kinds


@pytest.fixture(scope="module")
def field():
    return html_text.default_field()


def texts(page):
    return [b.text for b in blocks(page)]


class Plain(HTMLParser):
    """An article's blocks by the standard library's parser: text between tags that are not inline, code and form choices left out."""

    inline = set("a abbr b bdi bdo button cite code data del dfn em font i img ins kbd label mark math mi mn mo q s samp small span strike strong sub sup time tt u var wbr".split())
    void = set("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, page, inside):
        super().__init__(convert_charrefs=True)
        self.inside, self.depth, self.off, self.out, self.now = inside, 0, 0, [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.now).split())
        self.out += [text] * bool(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        elif tag not in self.inline:
            self.end()
        self.depth += tag == self.inside
        self.off += tag in ("script", "style", "noscript", "select", "textarea", "svg", "iframe")

    def handle_endtag(self, tag):
        if tag not in self.inline:
            self.end()
        self.depth -= tag == self.inside
        self.off -= tag in ("script", "style", "noscript", "select", "textarea", "svg", "iframe")

    def handle_data(self, data):
        if self.depth > 0 and not self.off:
            self.now.append(data)


def test_blocks():
    page = """<!doctype html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <!-- no <p>no</p> --><div class="a">one<br>two &amp; &lt;b&gt; <b>three</b>&nbsp;four<p>five<p title="a>b">six</div>se<i>ven</i>
    <ul><li>a<li>b</ul><div hidden>no</div><div style="display: none">no<p>no</p></div><noscript>no</noscript>5 < 6 & x &#233;<svg><text>no</text></svg><select><option>no</select></body>"""
    assert texts(page) == ["one two & <b> three four", "five", "six", "seven", "a", "b", "5 < 6 & x é"]
    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert texts("plain <") == ["plain <"] and texts("<script>var a = 1") == [] and texts("a<!-- b") == ["a"]
    b = blocks('<main id="siteMain"><nav class="x-links"><a href="#">home</a> now</nav></main>')[0]
    assert {"t=main", "t=nav", "c=site", "c=links", "c=link"} <= b.above and b.linked == 4 and b.path == "main>nav" and b.near == "menu"
    assert len(texts("<div>" * 3000 + "x")) == 1


def test_head_without_its_end_tag():
    head = "<html><head><meta charset=utf-8><title>no</title><style>p{}</style><template><p>no</p></template>"
    for rest in ("<body><p>one</p>", "<p>one</p>", "<body class='x'>one", "<img src=a>one", "<b>one</b>", " one"):
        assert texts(head + rest) == ["one"]
    assert texts(head + "<link rel=a></head><body>one") == ["one"] and texts("<head><template><p>no") == []


def test_decoding_is_the_best_of_all(field):
    page = blocks("<nav><a href='#'>a</a></nav><p>One two three four.</p><div class='ad'>Buy</div><p>Five six. Seven.</p><footer>&copy; x</footer>")
    emit = [sum(field.weights.get(x, 0) for x in f) for f in html_text.features(page)]

    def score(y):
        s = field.start[y[0]] + sum(e for e, k in zip(emit, y, strict=True) if k)
        return s + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))

    assert field.labels(page) == list(max(product((0, 1), repeat=len(page)), key=score))


def test_unseen_layouts(field):
    right = total = 0
    for page, truth in html_text.labelled_pages(range(500_000, 500_300)):
        got = field.labels(page)
        right += sum(a == b for a, b in zip(got, truth, strict=True))
        total += len(truth)
    assert right / total > 0.99


def test_given_pages(spark, field):
    sf_dir = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas().set_index("page_id")
    got = queries.op3_html(spark, sf_dir).toPandas()
    assert len(got) == len(pages) and (got.n_chars == got.text.map(len)).all()
    same = [t == "\n\n".join(Plain(h, "article").out) for t, h in zip(got.text, pages.html[got.page_id], strict=True)]
    assert np.mean(same) > 0.98


LAYOUT = """<body><div id="cookie-bar">We use cookies.</div><header><a href="/">Site</a></header><nav class="main"><a>x</a></nav>
<div class="layout"><div class="sidebar"><h4>More</h4><p>Other text here.</p></div><article class="post"><h1>Title here</h1><p>First words of it. And more of them.</p>
<div class="ad-box">Buy now. It is cheap.</div><p>Short.</p><form>Mail <input></form><ul><li>item one</li><li>item two</li></ul></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked it very much. Thanks.</p></div></section></div><footer>&copy; me</footer></body>"""


def test_a_layout_with_everything(field):
    assert field.text(LAYOUT) == "Title here\n\nFirst words of it. And more of them.\n\nShort.\n\nitem one\n\nitem two"


def test_odd_inputs(spark, field):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "<p>", "x"), (3, "u", "<article>" + "<p>Word and word.</p>" * 20_000, "x"), (3, "u", LAYOUT, "x"), (3, "u", LAYOUT, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.main_text(df, field).collect()
    assert len(got) == len(rows) and sorted(len(r.text) for r in got)[:3] == [0, 0, 0]
    assert max(len(r.text) for r in got) == 20_000 * 16 - 2
    assert html_text.main_text(df.limit(0), field).count() == 0


def test_text_that_a_browser_shows_is_never_dropped_beforehand():
    assert texts("<p>Where <math><mi>x</mi></math> is big.") == ["Where x is big."]
    assert texts("<p>Press <button>OK</button> to go on.") == ["Press OK to go on."] and blocks("<div><button>Go</button></div>")[0].linked == 2
    assert texts('<p aria-hidden="true">Seen.') == ["Seen."]


def test_layout_text_of_an_article(field):
    body = "<article><h1>A title of it</h1><p>Where <math><mi>x</mi></math> is big, so it is. And more of it.</p><p aria-hidden='true'>This is seen. It is part of the text.</p><p>Last words of it. Really the last.</p></article>"
    assert field.text(f"<nav><a href='/'>Home</a></nav>{body}<footer>&copy; me</footer>") == "A title of it\n\nWhere x is big, so it is. And more of it.\n\nThis is seen. It is part of the text.\n\nLast words of it. Really the last."


def test_depth_changes_nothing():
    """Elements are found however many others lie between."""
    spans = "<span>" * 40
    assert blocks(f"<a href='#'>{spans}word")[0].linked == 4
    assert texts(f"<p>one{spans}two<p>three") == ["onetwo", "three"] and "t=p" in blocks(f"<p>one{spans}two<p>three")[1].parent
    assert [sorted(x for x in b.above if x.startswith("t=")) for b in blocks(f"<ul><li>a{spans}b<li>c</ul>d")] == [["t=li", "t=ul"], ["t=li", "t=ul"], []]
    inner = blocks("<ul><li>a<ul><li>b<li>c</ul>d</ul><div>e</div>")
    assert [b.text for b in inner] == ["a", "b", "c", "d", "e"] and "t=li" in inner[3].parent and "t=ul" not in inner[4].above
    cell = blocks("<div class='x'><table><tr><td>a</div>b<td>c<tr><td>d</table>e</div>f")
    assert [b.text for b in cell] == ["a", "b", "c", "d", "e", "f"] and "c=x" in cell[4].above and "c=x" not in cell[5].above


def test_time_is_proportional_to_the_page(field):
    def seconds(n):
        page = "".join(f'<div class="c{i}">x' for i in range(n)) + "</span>" * n
        began = time.perf_counter()
        found = blocks(page)
        field.labels(found)
        assert len(found) == n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.5


def test_sums_along_the_elements_are_those_of_the_features(field):
    page, _ = html_text.html_samples.page(3)
    found = blocks(page)
    get = lambda x: field.weights.get(x, 0.0)
    for b, own, all_ in zip(found, html_text.shape(found), html_text.features(found), strict=True):
        assert abs(sum(map(get, own)) + b.node.weight(get) - sum(map(get, all_))) < 1e-9


def test_names_that_were_never_seen():
    """Trained with half of the names and reading the other half, whose kinds the field is not told either."""
    half = lambda k: ({kind: own[k::2] for kind, own in NAMES.items()}, MAIN[k::2])
    known = kinds(*half(0))
    field = html_text.train(html_text.labelled_pages(range(500), *half(0), known))
    right = total = 0
    for page, truth in html_text.labelled_pages(range(500_000, 500_200), *half(1), known):
        right += sum(a == b for a, b in zip(field.labels(page), truth, strict=True))
        total += len(truth)
    assert right / total > 0.88


def test_the_least_of_a_function():
    a = np.diag([1.0, 10.0, 100.0])
    got = html_text.least(lambda x: (float((x - 3) @ a @ (x - 3)), 2 * a @ (x - 3)), np.zeros(3), 60)
    assert np.allclose(got, 3, atol=1e-3)


# Pages as well-known kinds of sites have them, with the text that a reader would take from each.
BLOG = """<!doctype html><html lang=en><head><title>x</title></head><body class="single wp-blog"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href=/>My site</a></p><p class="site-description">Words about food</p></header>
<nav id="site-navigation" class="main-navigation"><ul><li><a href=/a>About</a><li><a href=/b>Recipes</a></ul></nav><div id="content" class="site-content"><main id="main"><article id="post-12" class="post hentry"><header class="entry-header"><h1 class="entry-title">How to bake bread</h1></header>
<div class="entry-content"><p>Bread needs time. It needs flour, water and salt as well.<p>Mix all of it. Then wait.<ul><li>500 g flour</li><li>350 g water</li></ul><blockquote><p>Bread is patience, said my aunt.</p></blockquote></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">Two thoughts</h2><ol class="comment-list"><li class="comment"><p>I tried it. It was fine!</p></li></ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href=/c>How to cook rice well</a></ul></section></aside><footer id="colophon" class="site-footer">Powered by a press</footer></div></body></html>"""
NEWS = """<html><body><div class="cookie-banner"><p>We use cookies to improve things. By going on you agree.</p><button>Agree</button></div><header><div class="logo"><a href="/">The Paper</a></div></header><nav><a href=/1>World</a> | <a href=/2>Sport</a></nav>
<main><article><h1>River rises again</h1><p>The river rose by two metres on Monday. People left their houses.</p><div class="advertisement"><p>Buy boats now. Cheap.</p></div><p>Rain is expected until Friday, officials said.</p><h2>What comes next</h2><p>Nobody knows. The mayor will speak today.</p></article></main>
<aside class="related"><h3>More stories</h3><ul><li><a href=/3>Bridge closed after the flood of last year</a></li></ul></aside><form class="newsletter"><p>Get our letter every day. It is free.</p><input type=email></form><footer>&copy; 2024 The Paper. All rights reserved.</footer></body></html>"""


@pytest.mark.parametrize("page, want", [(BLOG, ["How to bake bread", "Bread needs time. It needs flour, water and salt as well.", "Mix all of it. Then wait.", "500 g flour", "350 g water", "Bread is patience, said my aunt."]), (NEWS, ["River rises again", "The river rose by two metres on Monday. People left their houses.", "Rain is expected until Friday, officials said.", "What comes next", "Nobody knows. The mayor will speak today."])])
def test_sites_of_known_kinds(field, page, want):
    assert field.text(page).split("\n\n") == want
