import re

import html as entities
import pytest

from huskwatch.llm import html

FRAME = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body class="content"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, all of them, really all.</div>{}
<aside><p>Side story, with commas, and more, and more text that is long enough to score well.</p></aside>
<div class="ad">Buy, buy, buy, and buy again, because it is long, and it has commas.</div><form><p>Your mail, please, now, and then some.</p></form>
<section id="comments"><p>A reader says, at length, that all of this, and more, is wrong, wrong, wrong.</p></section><footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><h1>Head &amp; line</h1><p>First, with <b>bold,<br>text</b> &eacute;&#233;  here.<p>Second unclosed, paragraph</article>", ["Head & line", "First, with bold, text éé here.", "Second unclosed, paragraph"]),
    ("<div><h2>A</h2><p>Long enough, a paragraph, with commas, and text.</p><p>Tiny.</p><ul><li>one<li>two</ul></div>", ["A", "Long enough, a paragraph, with commas, and text.", "Tiny.", "one", "two"]),
    ("<main><header><h1>Own</h1></header><p>Text, text, text, text, and yet more text here.</p><!-- <p>no</p> --><div hidden>no</div></main>", ["Own", "Text, text, text, text, and yet more text here."]),
    ("<div class='post'><div>" + "<p>Long, long paragraph, with commas, and with words.</p>" * 9 + "</div><div><p>Short end.</p></div></div>",
     ["Long, long paragraph, with commas, and with words."] * 9 + ["Short end."]),
    ("<article><p><b>Bold never closed, in a first paragraph.<br><p>Next, second.</p><br></article>", ["Bold never closed, in a first paragraph.", "Next, second."]),
])
def test_article_without_its_surroundings(body, want):
    assert html.main_text(FRAME.format(body)).split("\n\n") == want


@pytest.mark.parametrize("mark, kind", [("post-footer", -1), ("main-content", 1), ("with-sidebar", 0), ("ad", -1), ("comment-body", -1), ("lead", 0), ("article", 1), ("-", 0), ("nav_bar", -1)])
def test_names(mark, kind):
    assert html.named(mark) == kind


def test_odd_input():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>  </p>") == html.main_text("<!-- open") == ""
    assert html.main_text("just a < b text &lt; &am") == "just a < b text < &am"
    assert html.main_text("<p>short</p>") == "short"
    assert html.main_text("<div>" * 20_000 + "deep, deep text that is long enough to be scored" + "</div>" * 20_000).startswith("deep")
    assert len(html.main_text("<article>" + "<p>some words, here.</p>" * 20_000 + "</article>").split("\n\n")) == 20_000
    assert html.main_text("<script>never closed <p>x</p>") == ""


@pytest.mark.parametrize("depth", [1, 5, 45, 400])
def test_nesting_costs_no_points(depth):
    """Paragraphs under wrappers of any depth in one container all stay; what surrounds them goes."""
    parts = [f"Paragraph {i}, with commas, and with enough words to score." for i in range(30)]
    body = "<div>" + "".join("<div>" * depth + f"<p>{p}</p>" + "</div>" * depth for p in parts) + "</div>"
    assert html.main_text(FRAME.format(body)).split("\n\n") == parts


def test_scores_stand_without_article_tags(spark):
    """With article and main elements as plain containers the pages give the same texts."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:article|main)(?=[\s>])", r"<\1div", r["html"])
        assert plain != r["html"] and html.main_text(plain) == html.main_text(r["html"])


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extracted(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n\n".join(filter(None, parts))


def test_edge_cases(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>é😀</p>", "x"), (1, None, None, "x")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, "", 0), (None, "u", "é😀", 2), (1, None, "", 0)], key=str)
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
