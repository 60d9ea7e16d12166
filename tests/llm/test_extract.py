from __future__ import annotations

import random
import re

import pandas as pd

from lakecairn.llm import extract, registry
from tests.conftest import SF


def test_article_of_a_usual_page():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
    <body><nav><ul><li><a href="/a">Home, sweet home and long menus</a></li></ul></nav><!-- x <p>no</p> -->
    <div class="ad">Buy this now, it is cheap.</div><div class="cookie-notice">We use cookies, as you know.</div>
    <article><header><h1>A &lt;title&gt;</h1><p>By nobody</p></header><p><b>First   part,
    with a break<br>and more.<br><p>Second&nbsp;part &#233;&eacute;.</p><p>x</p><ul><li>one<li>two</ul>
    <aside>Read also: everything else.</aside><form><label>Name</label></form>
    <div id="comments"><p>I disagree, said a reader, at length.</p></div></article>
    <footer>&copy; nobody</footer></body></html>"""
    assert extract.main_text(page).split("\n") == ["A <title>", "First part, with a break and more.", "Second part éé.", "x", "one", "two"]


def test_page_without_article():
    page = "<body><div class=menu><a href=/>a</a></div><div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div id=c><h2>Head</h2><p>" + "Some words, and more of them. " * 9 + "</p><p>Short.</p><p>" + "Other words; again. " * 9 + "</p></div><div><p><a href=/>next</a></p></div>"
    got = extract.main_text(page).split("\n")
    assert got[0] == "Head" and got[2] == "Short." and len(got) == 4


LONG = "Some words, and more of them; as such. " * 9


def test_threshold_decides_inside_an_article():
    links = "".join(f"<li><a href={k}>Another story to read {k}</a></li>" for k in range(6))
    page = f"<article><h1>T</h1><p>{LONG}</p><p>See <a href=/>this and that</a></p><p>{LONG}</p><ul><li><a href=/s>A source</a></li></ul><div><h3>More</h3><ul>{links}</ul></div><div><p>Short end.</p></div></article>"
    long = LONG.strip()
    assert extract.main_text(page).split("\n") == ["T", long, "See this and that", long, "A source", "Short end."]


def test_article_text_of_pages_without_article():
    page = f"<body><ul><li><a href=/>Home of all things</a></ul><div><p>{LONG}</p><section><p>{LONG}{LONG}</p><p>{LONG}</p><p><a href=/>see there</a></p></section><h4>Sources</h4><ul><li><a href=/>A source</a></ul></div><div><ul><li><a href=/>next</a></ul></div></body>"
    long = LONG.strip()
    assert extract.main_text(page).split("\n") == [long, f"{long} {long}", long, "see there", "Sources", "A source"]
    formula = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, then.</p><xmp>a <b> c</xmp></article>"
    assert extract.main_text(formula) == "So x=1, then.\na <b> c"


def test_wrappers_and_readers_comments():
    page = """<BODY CLASS="with-sidebar"><DIV class="wrap has-sidebar"><article class='post'><h2>T</h2><p>Text, as such.</p></article>
    <section id=comments><article class=comment><p>A reader says, at great length, that it is so.</p></article></section>
    <div role="complementary"><p>Else, where.</p></div><div hidden><p>Not, seen.</p></div></DIV></BODY>"""
    assert extract.main_text(page) == "T\nText, as such."


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "plain words only", "x"), (4, "u", "<p", "x"), (5, "u", "<div><p>a<p>b</div></b>c", "x"), (5, "u", "<div><p>a<p>b</div></b>c", "x"), (6, "u", "<article>" + "<p>word, " * 20000, "x"), (None, "u", "<script>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract.extract(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r.text for r in out}
    assert by[1] == by[2] == by[4] == by[None] == "" or by[4] == "<p"
    assert by[3] == "plain words only" and by[5].startswith("a\nb") and by[6].count("\n") == 19999
    assert extract.extract(df.limit(0)).count() == 0


def test_query_keeps_whole_articles(spark):
    import html as h

    got = {r.page_id: r for r in registry.op7_html_extraction(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id].text == "\n".join(x for x in parts if x)
        assert got[p.page_id].url == p.url


def _pages():
    return pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html.tolist()


def test_ratios_decide(monkeypatch):
    """With ratios that say nothing, or anything, most pages come out otherwise."""
    pages = _pages()
    found, real = [extract.main_text(p) for p in pages], extract.path_values
    same = lambda: sum(extract.main_text(p) == x for p, x in zip(pages, found)) / len(pages)
    monkeypatch.setattr(extract, "path_values", lambda blocks, width=1.0: dict.fromkeys(real(blocks), 1.0))
    assert same() < 0.2
    rnd = random.Random(4)
    monkeypatch.setattr(extract, "path_values", lambda blocks, width=1.0: {k: rnd.random() for k in real(blocks)})
    assert same() < 0.4


def test_articles_without_their_tag_and_without_class_names():
    pages = _pages()
    found = [extract.main_text(p) for p in pages]
    bare = [re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"(</?)article\b", r"\1div", p)) for p in pages]
    assert bare != pages and sum(extract.main_text(p) == x for p, x in zip(bare, found)) >= 0.95 * len(pages)


def test_what_stands_around_is_not_an_article():
    assert extract.main_text("<nav><a href=/>Home</a></nav><footer>Long words about rights, all of them; reserved.</footer>") == ""
    assert extract.main_text("<body><footer>Long words about rights, all of them; reserved. " + "More, and more. " * 30 + "</footer><div><p>Hi.</p></div></body>") == "Hi."
