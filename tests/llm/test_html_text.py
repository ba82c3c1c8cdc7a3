from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeweft.llm import html_text

CASES = {
    "<html><head><title>T</title></head><body><nav><a>x</a></nav><article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four</article><footer>f</footer>": "A & B\none two three\nfour",
    "<article><p><b>bold one<br><p>next</b> word</p>tail</article>": "bold one\nnext word\ntail",
    "<body><div id=main><p>kept</p></div><div class='side-bar sidebar'>no</div><div class=\"ad\">no</div><p>also</p></body>": "kept\nalso",
    "<article><p>x</p><script>var t=\"</p>\";</script><style>p{}</style><!-- <p>no</p> --><p>y&#233;&lt;b&gt;</p></article>": "x\nyé<b>",
    "<article><header><h1>Title</h1></header><p>a</p><aside>no</aside><form>no<input></form><section class=comments><p>no</p></section></article>": "Title\na",
    "<main><p>in</p></main><p>out</p>": "in",
    "<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>": "one\ntwo\nc1\nc2\nc3",
    "<article>plain <i>inline</i> text<article class=comment>no</article></article>": "plain inline text",
    "<article class=\"post has-sidebar\"><p hidden>no</p><p>yes</p><div style='display: none'>no</div></article>": "yes",
    "just text &copy; here": "just text © here",
    "<article><p class='share-price'>Up to 12.</p><div class='social-issues'>On rent.</div><section id='search-for-meaning'>A life.</section><div class='article-notice-board'>Lost cat.</div></article>": "Up to 12.\nOn rent.\nA life.\nLost cat.",
    "<article><p>x</p><div class='share-buttons'>no</div><div id=siteHeader>no</div><ul class='social-icons list'><li>no</ul><div class='related-stories'><a>no more</a> of</div></article>": "x",
    "": "",
    "<article></article>": "",
    "<p>unclosed <b": "unclosed <b",
}


@pytest.mark.parametrize("page", CASES)
def test_structure(page):
    assert html_text.main_text(html_text.parse(page)) == CASES[page]


def test_template_of_a_site_goes_and_articles_stay(spark):
    rows = []
    for i in range(12):
        shared = "<div><span>Our shop</span><p>Buy now</p></div>"
        rows.append((i, f"http://A.com/{i}", f"<body>{shared}<div><p>text {i}</p><p>same line</p></div></body>", "h"))
        rows.append((100 + i, f"http://b.com/{i}", f"<article><p>same line</p><div><p>box</p></div><p>text {i}</p></article>", "h"))
    rows += [(200, None, "<p>lone</p>", "h"), (201, "http://a.com/", None, "h"), (None, "x", "", None), (203, "http://c.com/", "<div>" * 5000 + "deep", "h"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("row", F.lit(1)).repartition(4)
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "host", "row", "main_text"]
    texts = {r.page_id: r.main_text for r in got.collect()}
    assert got.count() == len(rows)
    # "same line" recurs outside any article, so it is template on a.com; paragraphs of an article are not, recurring boxes are.
    assert texts[3] == "text 3" and texts[103] == "same line\ntext 3"
    assert texts[200] == "lone" and texts[201] == "" and texts[None] == "" and texts[203] == "deep"


def test_join_instead_of_broadcast_gives_the_same(spark, monkeypatch):
    rows = [(i, "http://a.com/", f"<p>menu</p><p>x{i}</p>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(html_text.extract(pages).collect())
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    assert sorted(html_text.extract(pages).collect()) == want and want[0].main_text == "x0"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    own = "<ul><li>first</li></ul><section><p>boxed</p></section>"
    article = f"<nav>menu</nav><article><p>words</p>{own}</article>"
    bare = "<body><div><p>alone</p></div><p>and more</p></body>"
    rows = [(i, f"http://a.com/{i % 7}", article) for i in range(20)]
    rows += [(100 + i, f"http://a.com/{i}", f"<article><p>text {i}</p><div>shop box</div></article>") for i in range(20)]
    rows += [(200 + i, f"http://b.com/{i}", bare) for i in range(10)] + [(300 + i, f"http://b.com/p{i}", f"<div>menu here</div><p>page {i}</p>") for i in range(10)]
    # Copies that differ outside the text only.
    rows += [(400 + i, f"http://c.com/{i}", f"<nav>{i}</nav><article><p>words</p>{own}</article>") for i in range(10)] + [(500, "http://c.com/", "<article><p>x</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    texts = {r.page_id: r.main_text for r in html_text.extract(pages).collect()}
    for i in range(20):
        assert texts[i] == "words\nfirst\nboxed" and texts[100 + i] == f"text {i}"
    for i in range(10):
        assert texts[200 + i] == "alone\nand more" and texts[300 + i] == f"page {i}" and texts[400 + i] == "words\nfirst\nboxed"


def test_a_box_on_many_pages_of_a_large_host_is_template(spark):
    box, line = "<div><p>Our offers</p></div>", "<p>Same line</p>"
    rows = [(i, f"http://a.com/{i}", f"<body>{box if i < 50 else ''}{line if i < 50 else ''}<p>text {i}</p></body>") for i in range(300)]
    rows += [(1000 + i, f"http://b.com/{i}", f"<body>{box if i < 49 else ''}<p>text {i}</p></body>") for i in range(300)]
    texts = {r.page_id: r.main_text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # Only containers go by number alone: a line of text that recurs on a sixth of the pages stays, but nothing of a box on fifty.
    assert texts[7] == "Same line\ntext 7" and texts[60] == "text 60" and texts[1007] == "Our offers\ntext 7"


STORY = "<div class=content><p>The council met on Monday and voted for the new bridge.</p><p>Work starts in spring, the mayor said.</p></div>"
KEPT = "The council met on Monday and voted for the new bridge.\nWork starts in spring, the mayor said."


@pytest.mark.parametrize("copies, others", [(60, 240), (5, 15), (30, 0)])
@pytest.mark.parametrize("article", [True, False])
def test_near_copies_keep_their_story(spark, copies, others, article):
    halves = "<div><p>One half of it is told in a box of its own.</p></div><div><p>The other half is told in another box here.</p></div>"
    box = "<div><p>Our shop</p></div>"

    def page(text):
        return f"<body>{'<article>' if article else ''}{text}{box}{'</article>' if article else ''}</body>"

    rows = [(i, f"http://a.com/{i}", page(f"<h1>Headline {i}</h1>{STORY}")) for i in range(copies)]
    rows += [(1000 + i, f"http://b.com/{i}", page(f"<p>{i} March</p>{halves}")) for i in range(copies if article else 0)]
    rows += [(2000 + i, f"http://{h}.com/x{i}", page(f"<p>Other text number {i} is about something else altogether.</p>")) for h in "ab" for i in range(others)]
    texts = {r.page_id: r.main_text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(copies):
        if article:
            # The box is template too, but deleting all that recurs would take most of these articles.
            assert texts[i] == f"Headline {i}\n{KEPT}\nOur shop"
            assert texts[1000 + i].startswith(f"{i} March\nOne half") and "The other half" in texts[1000 + i]
        elif others:
            assert texts[i] == f"Headline {i}\n{KEPT}"
    for i in range(others):
        assert texts[2000 + i] == f"Other text number {i} is about something else altogether."


def test_long_template_outside_articles_goes(spark):
    legal = "<div><p>All rights are reserved by us, and nothing on this site may be copied without our written permission.</p></div>"
    links = "<div><a>Home</a> <a>All about us</a> <a>What we sell</a> <a>Where to find us</a> <a>Jobs and people</a></div>"
    rows = [(i, f"http://a.com/{i}", f"<body><p>text {i}</p>{legal}{links if i % 3 == 0 else ''}</body>") for i in range(40)]
    texts = {r.page_id: r.main_text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(texts[i] == f"text {i}" for i in range(40))


def test_a_column_named_like_the_result_is_replaced(spark):
    pages = spark.createDataFrame([("http://a.b/c", "<article><p>Story of it.</p></article>", 5)], "url string, html string, main_text int")
    assert [tuple(r) for r in html_text.extract(pages).select("url", "main_text").collect()] == [("http://a.b/c", "Story of it.")]
