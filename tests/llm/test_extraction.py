import json
import random
import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rampart.llm.extraction import chosen, extract, meet, op13_extraction, wrapper_expressions
from rampart.llm.html_blocks import Page
from rampart.llm.wrappers import dumps, expression, leaves, merge_nodes, merged, numbered, of_page, places

PAGES = "page_id long, url string, html string"
W = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def words(seed, n):
    return " ".join(random.Random(seed).choices(W, k=n)).capitalize() + "."


def texts(html):
    return Page(html).texts


def shape(html):
    return numbered(of_page(Page(html).root))


def test_blocks_of_markup():
    assert texts("<p>a<b>b</b> c<br>d</p>e<div>f &amp;amp; &eacute;&#x41;&nbsp;g</div>") == ["ab c d", "e", "f &amp; éA g"]
    assert texts("<p>one<p>two<ul><li>x<li>y</ul>z") == ["one", "two", "x", "y", "z"]
    assert texts('<script>var t="</p><p>no";</script>yes<style>p{}</style><!-- <p>no --><title>no</title><textarea>no</textarea>') == ["yes"]
    assert texts("a < b <3 c > d & e &copy x &notit;") == ["a < b <3 c > d & e © x ¬it;"]
    assert texts('<p title="a>b">x</p><p don\'t>y</p><a href=a"b>z</a><p title="open>w</p>') == ["x", "y", "z", "w"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("<![CDATA[x & y]]><p>a\n\t b　c </p></p></div>") == ["x & y", "a b c"]
    assert texts("<title>lost<p>kept") == ["kept"] and texts("") == [] and texts("<") == ["<"] and texts("<script>a") == []
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == ["deep", "after"]


def test_links_are_counted():
    page = Page('<p>see <a href="x">here</a> now</p><li><a>all</a></li>')
    assert page.links == [4, 3]


def test_expressions():
    assert expression(shape("<body><nav><ul><li>a<li>b<li>c</ul></nav><h1>t</h1><p>1<p>2")) == "html(body(nav(ul(li(#)+)) h1(#) p(#)+))"
    pairs = shape("<body><h2>a</h2><p>1<h2>b</h2><p>2<p>3<h2>c</h2>")
    assert expression(pairs) == "html(body((h2(#)? p(#)?)+))" and len(leaves(pairs)) == 2
    both = merge_nodes(shape("<body><h1>t</h1><p>1<p>2<form>x</form>"), shape("<body><div class=x>a</div><h1>t</h1><p>1"))
    assert expression(both) == "html(body(div.x(#)? h1(#) p(#)+ form(#)?))"


ELEMENTS = st.recursive(st.sampled_from(["p", "h2", "li", "hr", "div"]).map(lambda t: f"<{t}>x</{t}>"), lambda inner: st.tuples(st.sampled_from(["div", "section", "ul", "article"]), st.lists(inner, max_size=5)).map(lambda x: f"<{x[0]}>{''.join(x[1])}</{x[0]}>"), max_leaves=25)


@settings(max_examples=60, deadline=None)
@given(st.lists(ELEMENTS, min_size=1, max_size=6))
def test_every_text_of_every_page_has_a_place(pages):
    shapes = [shape(p) for p in pages]
    wrapper = None
    for s in shapes:
        wrapper = merged(wrapper, dumps(s))
    wrapper = numbered(wrapper)
    for s in shapes:
        own = json.loads(dumps(s))
        assert min(places(own, wrapper), default=0) >= 0
        again = merged(json.loads(dumps(wrapper)), dumps(s))
        assert len(leaves(again)) <= len(leaves(wrapper)) + 2


def test_a_wrapper_stays_small():
    random.seed(4)
    wrapper = None
    for _ in range(400):
        inner = "".join(f"<{t}>x</{t}>" for t in random.choices(["p", "h2", "h3", "blockquote", "pre", "div", "table", "section"], k=random.randint(1, 40)))
        wrapper = merged(wrapper, dumps(shape(f"<body><nav>a</nav><article><h1>t</h1>{inner}</article>")))
    assert len(leaves(wrapper)) < 40
    wrapper = None
    for k in range(300):
        wrapper = merged(wrapper, dumps(shape(f"<body><div class=c{chr(97 + k % 26)}{chr(97 + k // 26)}x>a</div>" * 2)))
    assert len(leaves(wrapper)) < 200


def site(k, n, seed=0):
    """Page n of a site of make k and its main text."""
    body = [words(seed + 10_000 * k + 100 * n + i, 25 + (7 * n + i) % 30) for i in range(2 + n % 4)]
    title = words(seed + 777 * k + n, 5)
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in W[:6])
    side = f"<p>{words(n + 5, 12)}</p>"
    comments = "".join(f'<article class="comment"><p>{words(n + i, 30)}</p></article>' for i in range(3))
    makes = [
        f'<nav><ul>{menu}</ul></nav><div class="ad">{side}</div><article><h1>{title}</h1>{paragraphs}</article><footer>&copy; {words(n, 4)}</footer>',
        f'<header><h2>Site</h2></header><div id="cookie-banner">We use cookies {n}</div><main><h1>{title}</h1>{paragraphs}<form><input><label>Mail</label><button>Send</button></form></main><aside>{side}</aside><section id="comments">{comments}</section>',
        f'<div id="top">Welcome to the site</div><div class="menu">{menu}</div><div id="wrap"><div class="sidebar">{side}</div><div class="content"><h1>{title}</h1>{paragraphs}</div></div><div id="bottom">All rights kept by us</div>',
        f'<table><tr><td class="nav">{menu}<td><h1>{title}</h1>{paragraphs}<tr><td colspan=2 class="footer">Bye {n}</table>',
        f'<form id="aspnetForm"><div class="page-header">Name {n}</div><div class="post"><h1>{title}</h1><div class="entry-content">{paragraphs}</div><div class="share-buttons">Share on a b c</div></div><div id="respond">{comments}</div></form>',
        f'<noscript>Please enable scripts</noscript><div class="has-sidebar"><article><header><h1>{title}</h1></header>{paragraphs}<footer>Filed under {n}</footer></article><div role="complementary">{side}</div></div><div style="display: none">{side}</div>',
    ]
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a = '<p>';</script></head><body>{makes[k]}</body></html>", "\n".join([title, *body])


@pytest.mark.parametrize("pages_of_a_host", [1, 8])
def test_main_text_of_sites_of_six_makes(spark, pages_of_a_host):
    rows, want = [], {}
    for k in range(6):
        for n in range(pages_of_a_host):
            html, text = site(k, n)
            rows.append((100 * k + n, f"https://Www.s{k}.example:80/p/{n}?x", html))
            want[100 * k + n] = text
    got = extract(spark.createDataFrame(rows, PAGES).repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        assert r.text == want[r.page_id], r.page_id
        assert r.n_chars == len(r.text)


def test_a_host_of_copies_keeps_its_text(spark):
    html, text = site(2, 1)
    rows = [(i, "http://copies.example/x", html) for i in range(5)]
    assert {text in r.text for r in extract(spark.createDataFrame(rows, PAGES)).collect()} == {True}


def test_makes_of_one_host_are_told_apart(spark):
    """Pages without the elements that others of their host have still give their text."""
    rows = [(n, "http://mixed.example/", site(0 if n < 20 else 3, n)[0]) for n in range(24)]
    for r in extract(spark.createDataFrame(rows, PAGES)).collect():
        assert r.text == site(0 if r.page_id < 20 else 3, r.page_id)[1]


def test_result_does_not_depend_on_how_pages_lie(spark):
    random.seed(2)
    rows = [(100 * k + n, f"http://h{k % 2}.example/{n}", site(k, n)[0]) for k in range(6) for n in range(6)]
    one = sorted(map(tuple, extract(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()))
    random.shuffle(rows)
    assert sorted(map(tuple, extract(spark.createDataFrame(rows, PAGES).repartition(7)).collect())) == one
    found = {r.host: r.expression for r in wrapper_expressions(spark.createDataFrame(rows, PAGES)).collect()}
    assert set(found) == {"h0.example", "h1.example"} and "article" in found["h0.example"]


def test_rows_of_hot_keys_meet_once(spark):
    facts = spark.createDataFrame([("a", 5000, "x"), ("b", 1, "y"), ("c", 2, "z")], "k string, n long, v string")
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 9), ("c", 10), ("c", 11)], "k string, i int")
    assert sorted((r.i, r.v) for r in meet(rows, facts, ["k"], "n").collect()) == [(i, "x") for i in range(9)] + [(9, "y"), (10, "z"), (11, "z")]


def test_given_pages(spark, sf):
    """The articles of the given table, taken from its markup by patterns."""
    rows = {r.page_id: r for r in op13_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert rows[p.page_id].text == "\n".join(x for x in parts if x) and rows[p.page_id].url == p.url


def test_odd_rows(spark):
    long = "<article>" + "".join(f"<p>{words(i, 30)}</p><h3>x{i}</h3>" for i in range(3000)) + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "nonsense", "plain text"), (4, "http://a.example", "<nav>only</nav>"), (None, None, "<p>no id"), (5, "http://a.example", long), (6, "http://a.example", "<p>x"), (6, "http://a.example", "<p>x"), (7, "//[::1]/x", "<" * 3000 + "&" * 3000)]
    docs = spark.createDataFrame(rows, PAGES).selectExpr("*", "'mine' AS host", "'mine' AS key", "'mine' AS text", "'mine' AS shape", "'mine' AS kept")
    got = sorted(extract(docs).collect(), key=str)
    assert len(got) == 9 and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[4] == "" and by_id[3] == "plain text" and by_id[None] == "no id" and by_id[6] == "x"
    assert len(by_id[5].split("\n")) == 6000
    assert extract(docs.where("false")).collect() == []


def test_chosen_without_text():
    assert chosen(shape("<body><nav>x</nav>"), [(5.0, 100, False)]) == [] and chosen(shape(""), []) == []
