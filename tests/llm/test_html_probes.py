"""Markup that once lost whole articles, or let markup into the text."""
from __future__ import annotations

import pytest

from rebuff.llm import html_text

TEXT = "This is the first paragraph of an article, with enough words in it to be told from the furniture around it."
MORE = "The second paragraph goes on for a while too, and it ends the article after some more words of ordinary prose."
BODY = f"<p>{TEXT}</p><p>{MORE}</p>"
WANT = f"{TEXT}\n{MORE}"


@pytest.fixture(scope="module")
def tree():
    return html_text.grow(html_text.labelled_table())


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><body><article>{BODY}</article></body></html>",
    f"<html><head><meta charset=utf-8><script>if (a < b) document.write('<div>')</script><body><article>{BODY}</article>",
    f"<head><title>t</title></head><body><article>{BODY}</article>",
    f"<body><svg width='1'/><article>{BODY}</article></body>",
    f"<body><iframe src='x'/><article>{BODY}</article></body>",
    f"<body><form id=aspnet action=x><article>{BODY}</article></form></body>",
    f"<body><form id=aspnet action=x><div id=content>{BODY}</div></form></body>",
    f"<body><div class='page side-layout'>{BODY}</div></body>",
    f"<body><article><p title=it's>{TEXT}</p><p>{MORE}</p></article></body>",
    f"<body><article><p>{TEXT}<img alt=\"5\" screen\"></p><p>{MORE}</p></article></body>",
    f"<body><article><p data-x=\"a > b\">{TEXT}</p><p>{MORE}</p></article></body>",
    f"<body><article>{BODY}<form><label>Your name</label><button>Send</button></form></article></body>",
    f"<body><article>{BODY}</article><form><p>Search this site for whatever you like</p></form></body>",
])
def test_article_is_whole(tree, page):
    assert html_text.main_text(page, tree) == WANT


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p", ""), ("<head><title>only", ""), (f"<article><p>{TEXT} &amp; &lt;b&gt; &#x41;&nbsp;x</p>", f"{TEXT} & <b> A x"),
                                        (f"<article><ul><li>{TEXT}<ul><li>{MORE}</li></ul></li></ul></article>", WANT)])
def test_cases(tree, page, text):
    assert html_text.main_text(page, tree) == text


def test_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x"), (1, "u", f"<article>{BODY}</article>", "x"), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == sorted([(1, "u", WANT), (1, "u", WANT), (None, None, "")], key=str)
    assert html_text.extract(df.limit(0)).count() == 0
