"""Class words on layout wrappers, on the article itself and on p."""
from __future__ import annotations

import pytest

from rebuff.llm import html_text

P = "A paragraph of the article with a good number of words in it, so that it looks like prose to anybody."


@pytest.mark.parametrize("page", [
    f"<body><nav><a>home</a></nav><div class='content with-sidebar'><h1>Title here</h1><p>{P}</p><p>{P}</p></div></body>", f"<body><main class='no-comments'><p>{P}</p></main></body>",
    f"<body><article class='post social'><p>{P}</p></article></body>", f"<body><div class='social page'><div id=widget><article><p>{P}</p></article></div></div></body>"])
def test_wrappers_stay(page):
    assert P in html_text.main_text(page, html_text.grow(html_text.labelled_table()))


def test_marked_paragraphs_and_comments_go():
    page = (f"<body><article><p>{P}</p><p class=ad>Ad: {P}</p><p class='cookie-notice'>Cookie: {P}</p><p hidden>Hidden: {P}</p><p>{P}</p></article>"
            f"<section class=comments><article class=comment><p>Comment: {P}</p></article></section></body>")
    assert html_text.main_text(page, html_text.grow(html_text.labelled_table())) == f"{P}\n{P}"
