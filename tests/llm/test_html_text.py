import html
import re
import time

import numpy as np
import pytest

from termloom.llm import html_text as H
from termloom.llm.html_text import blocks, extracted, labeller, main_text, op2_html_text


def wanted(page):
    """The article of the test tables' pages: its headings and paragraphs."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_held_out_layouts():
    made = H.generated(200, seed=99)
    got = np.concatenate(H.labeller().label([p for p, _ in made]))
    assert (got == (np.concatenate([y for _, y in made]) > 0)).mean() > 0.99


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies.</p></div>
<main><article class="post"><h1>The  &amp; title</h1><script>var a = "<p>no</p>";</script>
<p>First <b>para</b>graph&nbsp;here,<br>next line &lt;kept&gt;.<p>Second one that goes on for a while, with words.
<div class="ad">Buy now!</div><ul><li>point one<li>point two</ul><!-- <p>hidden</p> --><p>Last words of it all.</p></article>
<section class="comments"><h2>Comments</h2><p>Nice read!</p></section></main>
<aside class="sidebar"><p>Popular stories</p></aside>
<form class="newsletter"><label>Your mail</label><button>Send</button></form>
<footer>&copy; 2020 Someone</footer></body></html>"""


def test_a_page_of_another_make(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain & text"), (1, "u", PAGE), (4, "u", "<article><p>" + "word " * 100_000 + "</article>"), (5, "u", "<p>open <!-- never closed"), (6, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    out = extracted(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r for r in out}
    want = ["The & title", "First paragraph here, next line <kept>.", "Second one that goes on for a while, with words.", "point one", "point two", "Last words of it all."]
    assert by[1].text == "\n\n".join(want)
    assert (by[2].text, by[3].text, by[6].text) == ("", "", "") and len(by[4].text) == 499_999
    assert extracted(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = op2_html_text(spark, sf_dir).collect()
    assert {r.page_id for r in out} == set(pages)
    assert all(r.text == wanted(pages[r.page_id]) for r in out)


@pytest.mark.parametrize("page,texts", [("<p>a<p>b", ["a", "b"]), ("x<div>y</div>z", ["x", "y", "z"]), ("a&#65;&eacute;<br>b", ["aAé b"]), ("<head>t</head><title>q</title>k", ["k"])])
def test_blocks(page, texts):
    assert [b[1] for b in H.blocks(page)] == texts


def text_of(body):
    return main_text(labeller(), [f"<html><body><article><h1>The title of it</h1>{body}</article></body></html>"])[0][0]


def test_quotes_in_attributes():
    for tag in ("<p title=it's>", '<p title="a > b">', "<p data-x='<b>' class=\"x\">", '<p title="abc>', "<p title='abc>", '<p title="a"class="b">', "<p title = \"x\">"):
        assert text_of(f"{tag}Hello there, this is the text.</p><p class=\"y\">And more of it here.</p>") == "The title of it\n\nHello there, this is the text.\n\nAnd more of it here.", tag


def test_text_inside_formulas_and_objects():
    got = text_of("<p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> and <object data='f'>a picture of it</object> and <canvas>a chart</canvas> end.</p>")
    assert got.endswith("The sum x+y and a picture of it and a chart end.")
    assert text_of("<p>Before.<script>var a = '<p>no</p>';</script> After.<!-- <p>no</p> --></p>").endswith("Before. After.")


def test_deep_and_unclosed_nesting():
    for page in ("<div>x" * 100_000, "<div>" * 100_000 + "text" + "</p>" * 100_000, "<p>a" * 50_000, "<table><tr><td>" * 30_000, "<p title=\"" * 20_000, "<!--" * 50_000, "<" * 200_000):
        began = time.time()
        found = blocks(page)
        assert time.time() - began < 5, page[:20]
        assert len(found) <= len(page)
    deep = main_text(labeller(), ["<div>" * 3000 + "<p>one</p>" + "</div>" * 3000])
    assert deep[0][1] == 1


def test_page_of_another_make():
    page = """<!doctype html><HTML><BODY class=home><DIV id=top-nav><UL><LI><A HREF=/a>Start</A><LI><A HREF=/b>News</A></UL></DIV>
    <DIV CLASS=container><DIV CLASS='post entry'><H1>A day at the sea</H1><P>The water was cold &amp; clear, and the wind came from the north all morning.
    <P>In the afternoon we walked along the dunes until it grew dark.<BLOCKQUOTE>It was worth the way.</BLOCKQUOTE></DIV>
    <DIV CLASS=comments><DIV CLASS=comment><P>Nice pictures!</P></DIV></DIV></DIV><DIV CLASS=footer>Copyright 2020</DIV></BODY></HTML>"""
    assert main_text(labeller(), [page])[0][0] == (
        "A day at the sea\n\nThe water was cold & clear, and the wind came from the north all morning.\n\nIn the afternoon we walked along the dunes until it grew dark.\n\nIt was worth the way."
    )
