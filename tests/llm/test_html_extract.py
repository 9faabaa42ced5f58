import html
import re
import time

import pyarrow.parquet as pq
import pytest
from tasklode.llm import html_extract
from tests.llm.shared import needs_testdata

ARTICLE = "<h1>Title</h1><p>First one, with several words. And more; yes.</p><p>Short.</p><p>Second &amp; long <b>bo</b>ld,\n again &nbsp; with words. Hm.</p>"
TEXT = "Title First one, with several words. And more; yes. Short. Second & long bold, again with words. Hm."
AROUND = (
    "<html><head><title>T</title><style>p{}</style></head><body><header class='site-header'><h2>Site</h2></header>"
    "<div class='cookie-notice'><p>We use cookies, ok? Accept them, please.</p></div><nav><ul><li><a href=x>Menu, one</a></ul></nav>"
    "<script>var t='</p><p>no';</script><!-- <p>no, never.</p> -->{}<form><p>Write, now.</p></form>"
    "<aside><p>Side, with words.</p></aside><div id='comments'><p>I like it, a lot. Yes.</p></div><footer><p>Imprint, all.</p></footer></body></html>"
)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div class=ad><p>Buy, now.</p></div>{}</main>", "<div><div class='content'>{}</div></div>", "<ARTICLE>{}"])
def test_the_article_alone(wrap):
    assert html_extract.extract(AROUND.replace("{}", wrap.replace("{}", ARTICLE))) == TEXT


def test_odd_pages():
    extract = html_extract.extract
    assert extract(None) == extract("") == extract("<!-- open") == extract("<script>x") == extract("<nav><a>x</a></nav>") == ""
    assert extract("plain text,\n no tags") == "plain text, no tags"
    assert extract("<p>a<br>b</p><p>c &lt; d</p>") == "a b c < d"
    assert extract("<p title='a>b' hidden-x>one, two</p") == "one, two"
    assert extract("<p>1 < 2, and 3 > 2</p>") == "1 < 2, and 3 > 2"
    assert len(extract("<article>" + "<p>some words, here.</p>" * 5_000)) == 5_000 * 18 - 1


PARAGRAPH = "<p>" + "words of a sentence, in a row. " * 10 + "</p>"
ITEMS = "<ul>" + "".join(f"<li>item {i} of some sixty characters without marks at its end</li>" for i in range(6)) + "</ul>"
TABLE = "<table><caption>Tab</caption>" + "".join(f"<tr><td>cell {i}<td>{i}</tr>" for i in range(4)) + "</table>"
LINKS = "<ul>" + "<li><a href=x>Unmarked link</a></li>" * 8 + "</ul>"


def plain(page):
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", page)).split())


@pytest.mark.parametrize("wrap", ["<div><div class='content'>{}</div></div>", "<div>{}</div>", "{}"])
@pytest.mark.parametrize("last", ["", PARAGRAPH])
def test_lists_and_tables_without_an_article_element(wrap, last):
    inner = ["<h1>Title</h1>", PARAGRAPH * 5, ITEMS, TABLE, "<pre>x = 1</pre>", PARAGRAPH * 5, TABLE, "<ol><li>One<li>Two</ol>", last]
    assert html_extract.extract(AROUND.replace("{}", wrap.replace("{}", "".join(inner)))) == plain("".join(inner))
    with_links = "".join([*inner[:3], LINKS, *inner[3:]])
    assert html_extract.extract(AROUND.replace("{}", wrap.replace("{}", with_links))) == plain("".join(inner))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div role=main>{}</div>"])
def test_lists_of_links_in_an_article(wrap):
    inner = ["<h1><a href=x>Title</a></h1>", PARAGRAPH, "<p>Short.</p>", ITEMS, "<p><a href=x>Linked</a> a word.</p>", TABLE]
    page = wrap.replace("{}", "".join([LINKS, *inner[:3], LINKS, *inner[3:], "<div><a href=x>Buy it now, here</a></div>", LINKS]))
    assert html_extract.extract(AROUND.replace("{}", page)) == plain("".join(inner))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>"])
@pytest.mark.parametrize(
    "inner",
    [
        "<h1>Title</h1><p><a href=x>Most of this first sentence is a link</a> here.</p><p>Short tail.</p>",
        f"<h1>Title</h1>{PARAGRAPH}<p><a href=x>A whole sentence is linked.</a></p>{PARAGRAPH}",
        f"<h1>Title</h1>{PARAGRAPH}<h2>Sources</h2>{LINKS}",
        f"{PARAGRAPH}<p>So <math><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup><annotation>b^2</annotation></math> holds.</p>",
        f"{PARAGRAPH}<noscript><p>A figure, as text.</p></noscript><object data=x><p>Its fallback, in words.</p></object>",
    ],
)
def test_articles_keep_all_their_text(wrap, inner):
    want = plain(re.sub(r"<annotation>.*?</annotation>", "", re.sub(r"</?(?:m[a-z]+)>", "", inner)))
    assert html_extract.extract(AROUND.replace("{}", wrap.replace("{}", inner))) == want


def test_ratios_judge_links_in_an_article(monkeypatch):
    inner = f"<h1>Title</h1>{PARAGRAPH * 3}<div><a href=x>Buy it now, here</a></div>"
    page = AROUND.replace("{}", f"<article>{inner}</article>")
    assert html_extract.extract(page) == plain(f"<h1>Title</h1>{PARAGRAPH * 3}")
    monkeypatch.setattr(html_extract, "content_paths", lambda blocks: dict.fromkeys((b.element.label for b in blocks), 1.0))
    assert html_extract.extract(page) == plain(inner)


def test_the_article_with_more_content_of_two():
    page = f"<div><article><p>A teaser, with words.</p></article><article>{PARAGRAPH * 2}</article></div>"
    assert html_extract.extract(AROUND.replace("{}", page)) == plain(PARAGRAPH * 2)


@pytest.mark.parametrize("words", ["content right-sidebar", "has-comments post", "share-page widget", "site banner"])
@pytest.mark.parametrize("wrap", ["<div class='{w}'><article>{}</article></div>", "<main><section id='{w}'>{}</section></main>", "<div class='{w}'>{}</div>"])
def test_class_words_around_the_article(words, wrap):
    inner = f"<h1>Title</h1>{PARAGRAPH * 3}{ITEMS}<p>An end, at last.</p>"
    advert = "<div class='ad'><p>Buy, now.</p></div>"
    page = wrap.replace("{w}", words).replace("{}", f"<h1>Title</h1>{PARAGRAPH * 3}{advert}{ITEMS}<p>An<span class=ad> advert</span> end, at last.</p>")
    assert html_extract.extract(AROUND.replace("{}", page)) == plain(inner)


def test_marked_inline_elements_and_long_comments():
    inline = f"<article><span class='share'>{'words of a sentence, in a row. ' * 10}</span></article>"
    assert html_extract.extract(inline) == plain(inline)
    comments = f"<article>{PARAGRAPH}</article><section class=comments>{'<p>I like it, a lot.</p>' * 30}</section>"
    assert html_extract.extract(comments) == plain(PARAGRAPH)


@pytest.mark.parametrize("wrap", ["<div><div>{}</div></div>", "<article>{}</article>"])
def test_ratios_pick_the_node(wrap, monkeypatch):
    inner = f"<h1>Title</h1>{PARAGRAPH * 6}"
    rows = "".join(f"<div>entry {i}</div>" for i in range(400))
    other = f"<article>{rows}</article>" if "article" in wrap else f"<section>{rows}</section>"
    page = AROUND.replace("{}", other + wrap.replace("{}", inner))
    assert html_extract.extract(page) == plain(inner)
    monkeypatch.setattr(html_extract, "content_paths", lambda blocks: dict.fromkeys((b.element.label for b in blocks), 1.0))
    assert "entry 7" in html_extract.extract(page)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + PARAGRAPH, "<span>" * 50_000 + "<p>x</p> y" * 50_000, "<div>" * 50_000 + "</x>" * 50_000 + PARAGRAPH,
        "<li><div>" + "<span>" * 40_000 + "<li>a</li>" * 40_000, "<ul><li>" * 40_000 + PARAGRAPH, "<div class=ad>" * 50_000 + PARAGRAPH * 2,
    ],
)
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 8


@needs_testdata
def test_whole_articles_of_the_test_pages():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))
        assert html_extract.extract(page) == " ".join(html.unescape(inner).split())


def test_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "v", AROUND.replace("{}", ARTICLE)), (2, "v", AROUND.replace("{}", ARTICLE))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = html_extract.extract_pages(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == sorted([("1", 0), ("None", 0), ("2", len(out[2].text)), ("2", len(out[2].text))])
    assert html_extract.extract_pages(df.limit(0)).count() == 0
