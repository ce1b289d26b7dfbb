"""Main-text extraction: flat text blocks, described by their own and their neighbours' word counts and link
densities, classified by a decision tree that is trained on a small labelled table.

A page is cut into flat blocks at block-level tags; inline tags do not cut. Each block also knows whether it
stands inside an element whose tag, role, class or id names page furniture, and inside article or main. The
labelled table is ``EXAMPLES``: small pages whose blocks carry their label as first character. The tree (Gini
impurity, exact thresholds) is grown from it once per query and travels with the plan.

Defined cases: null or empty html gives an empty text; broken or unclosed tags end with the page; unknown
character references stay as they are; a head without an end tag ends at the first tag that cannot stand in one;
rows that repeat an id are treated one by one; an empty table gives no rows; only ``keep`` and the text are returned.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Tags that do not end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags without content of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tags, roles and class or id words of page furniture.
FURNITURE_TAGS = set("nav aside footer form header menu dialog button select option".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu".split())
FURNITURE_WORDS = set("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
                      "footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing related "
                      "recommended comment comments reply replies respond disqus form login pagination pager widget copyright toolbar skip".split())
#: Attributes: a quote opens a value only behind an equals sign, so an apostrophe in an unquoted value or an odd quote does not.
_ATTRIBUTES = r"((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)"
#: Comments; elements whose content is no text, empty if they close themselves (which scripts, styles and text areas cannot); a head,
#: which ends at the latest before the first tag that cannot stand in one; declarations; tags.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:svg|template|object|iframe)\b[^>]*/>|<(script|style|noscript|template|svg|iframe|object|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|"
                    r"<head\b[^>]*>(?:<(script|style|noscript)\b[^>]*>.*?</\2\s*>|.)*?(?:</head\s*>|(?=<(?!/?(?:base|link|meta|noscript|script|style|template|title)\b)[a-zA-Z])|\Z)|<[!?][^>]*>|"
                    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)" + _ATTRIBUTES + r">", re.S | re.I)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: Names that tell of a layout with or without furniture, not of furniture: with-sidebar, no-comments.
_LAYOUT = re.compile(r"(?<![^\s])(?:with|without|no|has|hide|show)[-_][^\s]*")
#: Depth that an element counts for if more than a class word marks it.
HARD = 2
FEATURES = ("words", "link_density", "before_words", "before_density", "after_words", "after_density", "furniture", "article", "list_item")

#: The labelled table: every block's text starts with + (main text) or - (the rest).
EXAMPLES = (
    "<body><nav><ul><li><a>-home</a></li><li><a>-about us</a></li></ul></nav><div class=ad>-Buy this now for less than ever before.</div><article><h1>+A title of a few words</h1>"
    "<p>+A first paragraph with a good number of words in it, so that it looks like prose to anybody.</p><p>+Short.</p><p>+One more paragraph that goes on for a while and ends here.</p></article>"
    "<footer>-© site · all rights</footer></body>",
    "<body><header><div>-Site name</div><a>-log in</a></header><main><h1>+Title</h1><p>+Words of the text that the page is about, several of them in a row.</p>"
    "<ul><li>+First point of a list in the text</li><li>+Second point of it</li></ul><p>+The end.</p></main><aside><h3>-Related</h3><a>-another story</a></aside></body>",
    "<body><div class=menu><a>-news</a> <a>-sport</a></div><div id=content><h1>+Plain page without an article element</h1><p>+This paragraph has more than a dozen words, and it holds no link at all, as text does.</p>"
    "<p>+This one has fifteen words or more as well, and it mentions <a>a link</a> along the way to its end.</p></div><div class=sidebar>-Popular posts of the week, with many words that look like prose but are not part of it.</div></body>",
    "<body><article><p>+Text at the start of the article, of ordinary length and with ordinary words.</p><div class=notice>-We use cookies on this site to make it better for all of its readers.</div>"
    "<p>+Text after it.</p><form>-Your mail address <button>-send</button></form></article><section class=comments><p>-A reader says that this was a great article, and that they enjoyed it a lot indeed.</p><p>-Me too</p></section></body>",
    "<body><div>-<a>one</a> <a>two</a> <a>three</a></div><div>-Menu</div><div><p>+A long paragraph in a bare page whose words are many and whose links are none, which is text.</p>"
    "<p>+Another such paragraph follows it with no fewer words than it had, and no link in it either.</p></div><div>-<a>terms</a> <a>privacy</a></div></body>",
    "<body><div>-<a>back</a></div><article><h1>+Title</h1><p>+Yes.</p><p>+A paragraph that stands between two very short ones, and is itself of some length, as one can see.</p><p>+No.</p>"
    "<p>+A second long paragraph between short ones, which keeps going on until it has enough words to count.</p><p>+Perhaps.</p></article><div>-Menu</div><div>-Imprint</div></body>",
    "<body><div>-Advertisement</div><div>-<a>Skip to the text</a></div><article><p>+So.</p><p>+It.</p><p>+Is.</p><p>+A row of one-word paragraphs.</p></article><div>-Top</div></body>",
    "<body><div class=ad>-Only today: a long advertisement of more than twenty words, which stands right before a long title, so that its neighbours look like text.</div><article><h1>+A title that is as long as a "
    "paragraph, since it repeats the first sentence of the article in full length, twenty words and more</h1><p>+Text.</p></article><div class=promo>-Another long advertisement of some twenty words stands after the "
    "text and before the footer, and has no link in it.</div><footer>-Imprint and contact of the people who run this site, in a long line of about twenty words, as such lines can be.</footer></body>",
    "<body><div class=banner>-Sale</div><div><h2>+Bare title</h2><p>+The first of the paragraphs in a page without article, with many words, and more of them, and then some more for good measure.</p>"
    "<p>+The second paragraph in that page, which has as many words as the one before it, or nearly as many, to be honest.</p></div><div class=cookie>-This site uses cookies, and by reading on you agree to all that "
    "is said about them in the policy, which nobody reads.</div><div><p>+The third paragraph in that page comes after the notice and goes on where the second ended, again at some length, until its end.</p></div></body>",
    "<body><article><header><h1>+Title inside the article's own header</h1></header><p>+Body text that is long enough to be told from the furniture around it.</p><p><a>+A line of the article that is all link</a></p></article>"
    "<footer><p>-A long footer text that tells who owns the site and where they live, at length and in full.</p></footer></body>",
)


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, features) of every non-empty block, in page order."""
    found: list[list] = []              # text, link characters, furniture, article, list item
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = []     # tag, furniture, article
    forms: list[list[int]] = []                 # first block, block behind the last, depth of the stack; still open
    closed: list[list[int]] = []
    furniture = depth_a = 0
    article = item = para = seen = False       # para: a marked p is open; seen: there was an article or main

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            links = len(" ".join(html.unescape(" ".join(linked)).split())) if linked else 0
            found.append([text, links, furniture + para, article, item])
        parts.clear()
        linked.clear()

    def add(raw: str) -> None:
        if raw:
            parts.append(raw)
            if depth_a:
                linked.append(raw)
    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m.group(4) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(3))
        if tag == "a":
            depth_a = max(0, depth_a - 1) if closing else depth_a + 1
        if tag == "br":
            parts.append(" ")
        if tag in INLINE:
            if tag not in VOID and not closing and _marked(tag, m.group(5), False):
                flush()
                furniture += 1
                stack.append((tag, 1, article))
            elif closing and stack and stack[-1][0] == tag:
                flush()
                furniture -= stack.pop()[1]
            continue
        flush()
        para = tag == "p" and not closing and _marked(tag, m.group(5), article)
        if tag in VOID or m.group(0).endswith("/>"):
            continue
        if closing:
            if any(s[0] == tag for s in stack):
                while stack:
                    name, own, was = stack.pop()
                    furniture -= own
                    if forms and name == "form" and forms[-1][1] < 0 and forms[-1][2] == len(stack):
                        forms[-1][1] = len(found)
                        closed.append(forms.pop())
                    article = was
                    if name == tag:
                        break
            item = False
            depth_a = 0
        elif tag not in ("p", "body", "html"):
            main = tag in ("article", "main") and not seen
            if main:        # class words mark neither the page's first article or main nor what is around it
                seen = True
                stack = [(name, o if o == HARD else 0, was) for name, o, was in stack]
                furniture = sum(o for _, o, _ in stack)
            hard = _marked(tag, m.group(5), article, False)
            own = HARD if hard else int(not main and _marked(tag, m.group(5), article))
            if tag == "form" and own:
                forms.append([len(found), -1, len(stack)])
            stack.append((tag, own, article))
            furniture += own
            article = article or tag in ("article", "main")
            item = tag in ("li", "dt", "dd", "option", "td", "th")
    add(page[at:])
    flush()
    words = [len(b[0].split()) for b in found]
    for start, end, _ in closed + [[f[0], len(found), 0] for f in forms]:
        if 2 * sum(words[start:end]) > sum(words):     # a form around most of the page is its frame, and marks nothing
            for b in found[start:end]:
                b[2] -= HARD
    density = [min(1.0, b[1] / len(b[0])) for b in found]
    out = []
    for k, b in enumerate(found):
        before, after = (words[k - 1], density[k - 1]) if k else (0, 0.0), (words[k + 1], density[k + 1]) if k + 1 < len(found) else (0, 0.0)
        out.append((b[0], [words[k], density[k], *before, *after, float(b[2] > 0), float(b[3]), float(b[4])]))
    return out


def _marked(tag: str, attributes: str | None, in_article: bool, by_words: bool = True) -> bool:
    """Whether an element is page furniture by its tag, role, class, id or because it is hidden."""
    if tag in FURNITURE_TAGS and not (tag == "header" and in_article):
        return True
    if not attributes:
        return False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in FURNITURE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if by_words and name in ("class", "id") and FURNITURE_WORDS.intersection(_SPLIT.split(_LAYOUT.sub(" ", value))):
            return True
    return False


def labelled_table(pages: tuple[str, ...] = EXAMPLES) -> list[tuple[list[float], bool]]:
    """The features and labels of the example pages' blocks. The label does not count as text."""
    rows = []
    for page in pages:
        clean = blocks(re.sub(r"([>\s]|^)[+-](?=\S)", r"\1", page))
        rows += [(f, t[0] == "+") for (t, _), (_, f) in zip(blocks(page), clean, strict=True)]
    return rows


def grow(rows: list[tuple[list[float], bool]], depth: int = 5, least: int = 1):
    """A binary tree: (feature, threshold, below, above), or the label at a leaf."""
    yes = sum(y for _, y in rows)
    if depth == 0 or yes in (0, len(rows)):
        return 2 * yes >= len(rows)
    gini = lambda n, k: 2.0 * k * (n - k) / n
    best = None
    for f in range(len(FEATURES)):
        ordered = sorted(rows, key=lambda r: r[0][f])
        left = 0
        for i in range(1, len(ordered)):
            left += ordered[i - 1][1]
            lo, hi = ordered[i - 1][0][f], ordered[i][0][f]
            if lo < hi and least <= i <= len(ordered) - least:
                cost = gini(i, left) + gini(len(ordered) - i, yes - left)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, (lo + hi) / 2)
    if best is None:
        return 2 * yes >= len(rows)
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1, least), grow([r for r in rows if r[0][f] > cut], depth - 1, least)


def classify(tree, features: list[float]) -> bool:
    while not isinstance(tree, bool):
        f, cut, below, above = tree
        tree = below if features[f] <= cut else above
    return tree


def main_text(page: str | None, tree) -> str:
    return "\n".join(t for t, f in blocks(page or "") if classify(tree, f))


def extract(pages: DataFrame, column: str = "html", output: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` plus the main text, one row per input row."""
    tree = grow(labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, tree) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(texts, pa.string())], [*keep, output])
    d = pages.select(*keep, F.col(column).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{schema}, `{output}` string")
