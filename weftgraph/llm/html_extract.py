"""Main-text extraction from HTML by a decision tree over flat text blocks.

A page is cut into flat blocks at block-level tags. A block has its words and link density,
those of its neighbours, and what encloses it; a small CART, trained at import on the
labelled table below, tells main text from boilerplate. Character references are decoded,
white space in a block becomes one space, and main blocks are joined by a newline.

Pages are independent: one pass, no shuffle, memory of one page.

Edge cases: null or empty html gives an empty text; unclosed tags, comments, scripts and
attribute quotes end with the page or at the first '>'; truncated character references stay
as they are; repeated rows are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

SKIP = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object", "select", "textarea", "button", "title"}
RAW = {"script", "style", "title", "textarea"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MAIN_TAGS = {"article", "main"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CLOSES_P = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "blockquote", "pre", "footer", "header", "nav", "aside", "form", "main", "hr", "dl", "figure"}
_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|comments?|replies|disqus|respond|sidebar|menu|nav\w*|breadcrumbs?|footer|header|masthead|related|recommend\w*|share|sharing|social|widget|toolbar|login|signup|search)(?:$|[\s_-])", re.I)
#: Class words that speak of a page's layout or of an article's own head, not of what the element is.
_LAYOUT = re.compile(r"(?:^|\s)(?:(?:has|with|no|without)-[\w-]+|(?:entry|post|article|content|story)-header)(?=$|\s)", re.I)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")

#: (words, link density, words before, link density before, words after, link density after, in boilerplate, in article, heading) -> main
LABELLED = [
    ((1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), 0), ((2, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0), ((3, 1.0, 2, 1.0, 12, 0.0, 0, 0, 0), 0),
    ((9, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0), 0), ((18, 0.0, 1, 1.0, 7, 0.0, 1, 0, 0), 0), ((60, 0.0, 80, 0.0, 40, 0.0, 1, 0, 0), 0), ((14, 0.0, 50, 0.0, 0, 0.0, 1, 0, 0), 0),
    ((10, 0.1, 55, 0.0, 0, 0.0, 1, 0, 0), 0), ((25, 0.0, 70, 0.0, 25, 0.0, 1, 1, 0), 0), ((12, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0), 0), ((5, 0.9, 40, 0.0, 40, 0.0, 1, 1, 0), 0),
    ((4, 0.0, 2, 1.0, 60, 0.0, 1, 0, 1), 0), ((6, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0), 0), ((8, 0.8, 5, 0.9, 4, 1.0, 0, 0, 0), 0), ((5, 0.0, 2, 0.9, 0, 0.0, 0, 0, 0), 0),
    ((4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1), 0), ((30, 0.9, 10, 0.9, 10, 0.9, 0, 0, 0), 0), ((7, 0.0, 12, 0.9, 3, 0.9, 0, 0, 0), 0), ((3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0), 0),
    ((11, 0.0, 9, 0.0, 48, 0.0, 0, 1, 1), 1), ((48, 0.0, 11, 0.0, 33, 0.0, 0, 1, 0), 1), ((33, 0.0, 48, 0.0, 5, 0.0, 0, 1, 0), 1), ((5, 0.0, 33, 0.0, 10, 0.0, 0, 1, 0), 1),
    ((1, 0.0, 20, 0.0, 10, 0.0, 0, 1, 0), 1), ((1, 1.0, 40, 0.0, 30, 0.0, 0, 1, 0), 1), ((40, 0.5, 40, 0.0, 30, 0.0, 0, 1, 0), 1), ((2, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0), 1),
    ((5, 0.0, 0, 0.0, 20, 0.0, 0, 1, 0), 1), ((2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), 1), ((11, 0.0, 0, 0.0, 3, 0.0, 0, 1, 1), 1), ((3, 0.0, 1, 1.0, 2, 0.0, 0, 1, 0), 1),
    ((8, 0.0, 1, 1.0, 5, 0.0, 0, 1, 1), 1), ((12, 0.0, 3, 1.0, 40, 0.0, 0, 1, 0), 1), ((6, 0.0, 30, 0.0, 2, 1.0, 0, 1, 0), 1), ((2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0), 1),
    ((50, 0.3, 2, 1.0, 10, 0.0, 0, 1, 0), 1), ((4, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0), 1), ((90, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0), 1), ((1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), 1),
    ((60, 0.0, 4, 1.0, 55, 0.0, 0, 0, 0), 1), ((45, 0.1, 60, 0.0, 3, 1.0, 0, 0, 0), 1), ((30, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0), 1), ((9, 0.0, 5, 1.0, 60, 0.0, 0, 0, 1), 1),
    # outside an article, short blocks are what their neighbours are
    ((3, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0), 1), ((5, 0.0, 35, 0.0, 50, 0.0, 0, 0, 0), 1), ((2, 0.0, 25, 0.1, 45, 0.0, 0, 0, 0), 1), ((6, 0.0, 80, 0.0, 30, 0.0, 0, 0, 1), 1),
    ((4, 0.0, 30, 0.0, 22, 0.0, 0, 0, 0), 1), ((7, 0.0, 45, 0.0, 70, 0.1, 0, 0, 0), 1), ((3, 0.0, 28, 0.0, 33, 0.0, 0, 0, 1), 1), ((1, 0.0, 40, 0.0, 90, 0.0, 0, 0, 0), 1),
    ((5, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0), 0), ((4, 0.0, 1, 1.0, 50, 0.0, 0, 0, 0), 0), ((3, 0.0, 45, 0.0, 3, 1.0, 0, 0, 0), 0), ((6, 0.0, 2, 1.0, 70, 0.0, 0, 0, 0), 0),
    # and blocks of middle length between links are notices and teasers
    ((10, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((14, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0), 0), ((9, 0.0, 3, 1.0, 1, 1.0, 0, 0, 0), 0), ((12, 0.0, 4, 0.9, 2, 1.0, 0, 0, 0), 0), ((11, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0), 0),
    ((10, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0), 1), ((14, 0.0, 45, 0.0, 3, 1.0, 0, 0, 0), 1), ((9, 0.0, 30, 0.0, 28, 0.0, 0, 0, 0), 1), ((13, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0), 1), ((40, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), 1),
    ((40, 0.0, 1, 1.0, 2, 0.0, 0, 0, 0), 1), ((60, 0.0, 2, 1.0, 1, 0.0, 0, 0, 0), 1), ((28, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0), 1), ((35, 0.0, 3, 1.0, 1, 0.0, 0, 0, 0), 1),
    ((12, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0), 1), ((25, 0.2, 25, 0.1, 30, 0.0, 0, 0, 0), 1), ((90, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1), ((8, 0.0, 40, 0.0, 35, 0.1, 0, 0, 1), 1),
]


def grow(rows: list, depth: int = 6):  # noqa: ANN201
    """A CART by Gini impurity: a class, or (feature, limit, tree at most limit, tree above)."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            left = [r for r in rows if r[0][f] <= cut]
            right = [r for r in rows if r[0][f] > cut]
            gini = sum(len(s) * (p := sum(y for _, y in s) / len(s)) * (1 - p) for s in (left, right))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, cut, left, right)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, left, right = best
    return f, cut, grow(left, depth - 1), grow(right, depth - 1)


@cache
def tree():  # noqa: ANN201
    return grow(LABELLED)


def classify(features: tuple) -> int:
    t = tree()
    while isinstance(t, tuple):
        t = t[2] if features[t[0]] <= t[1] else t[3]
    return t


def _tag_end(s: str, i: int, state: dict) -> int:
    """Place of the '>' that ends the tag begun before ``i``; quotes hide '>' if they are closed. -1: none."""
    while True:
        j = s.find(">", i)
        if j < 0:
            return -1
        q = next((p for p in range(i, j) if s[p] in "\"'"), -1) if ('"' in s[i:j] or "'" in s[i:j]) else -1
        if q < 0:
            return j
        mark = s[q]
        if state.get(mark, len(s)) <= q:
            return j
        e = s.find(mark, q + 1)
        if e < 0:
            state[mark] = q
            return j
        i = e + 1


def _events(s: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', tag, attributes) and ('close', tag, '')."""
    i, n, state = 0, len(s), {}
    low = None
    while i < n:
        j = s.find("<", i)
        if j < 0:
            yield "text", s[i:], ""
            return
        if j > i:
            yield "text", s[i:j], ""
        c = s[j + 1 : j + 2]
        if s.startswith("<!--", j):
            e = s.find("-->", j + 4)
            i = n if e < 0 else e + 3
        elif c in ("!", "?"):
            e = s.find(">", j)
            i = n if e < 0 else e + 1
        elif c.isalpha() or (c == "/" and s[j + 2 : j + 3].isalpha()):
            e = _tag_end(s, j + 1, state)
            if e < 0:
                return  # a tag cut off by the end of the page
            body = s[j + 1 : e]
            if c == "/":
                yield "close", body[1:].split()[0].lower() if body[1:].split() else "", ""
                i = e + 1
                continue
            m = re.match(r"[^\s/]+", body)
            tag = m[0].lower()
            yield "open", tag, body[m.end() :]
            i = e + 1
            if tag in RAW:
                low = low if low is not None else s.lower()
                k = low.find(f"</{tag}", i) if len(low) == n else s.find(f"</{tag}", i)
                if k > i:
                    yield "text", s[i:k], ""
                i = n if k < 0 else k
        else:
            yield "text", "<", ""
            i = j + 1


def blocks(s: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Flat blocks of a page: text, words, words in links, in boilerplate, in article, heading."""
    out: list = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, skip, boilerplate, article
    parts: list[str] = []
    linked = 0
    skip = boiler = article = False
    heading = anchor = False

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                out.append((text, text.count(" ") + 1, linked, boiler, article, heading))
            parts.clear()
        linked = 0

    def pop(tag: str) -> None:
        nonlocal skip, boiler, article
        while stack:
            t, skip, boiler, article = stack.pop()
            if t == tag:
                break

    for kind, x, attrs in _events(s):
        if kind == "text":
            if not skip:
                parts.append(x)
                if anchor:
                    linked += len(x.split())
            continue
        if x in INLINE:
            if x == "br":
                parts.append(" ")
            elif x == "a":
                anchor = kind == "open"
            continue
        end()
        anchor = False
        if kind == "open":
            if x in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop("p")
                        break
                    if stack[k][0] not in ("p",):
                        break
            if x in VOID or attrs.endswith("/"):
                continue
            stack.append((x, skip, boiler, article))
            named = any(_NAMED.search(_LAYOUT.sub(" ", next(filter(None, m.groups()), ""))) for m in _ATTR.finditer(attrs)) if attrs and x not in ("html", "body", "article", "main") else False
            skip = skip or x in SKIP
            boiler = boiler or x in BOILER_TAGS or named
            article = article or x in MAIN_TAGS
            heading = len(x) == 2 and x[0] == "h" and x[1].isdigit()
        else:
            heading = False
            if any(t == x for t, *_ in stack):
                pop(x)
    end()
    return out


def main_text(s: str | None) -> str:
    b = blocks(s or "")
    rate = lambda k: (b[k][1], min(1.0, b[k][2] / b[k][1])) if 0 <= k < len(b) else (0, 0.0)
    return "\n".join(x[0] for k, x in enumerate(b) if classify((*rate(k), *rate(k - 1), *rate(k + 1), int(x[3]), int(x[4]), int(x[5]))))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
