"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut into flat blocks of text at block-level tags. Each block is described by its
word count and link density, those of the block before and after it, and three marks of
where it stands (heading, inside an article element, inside a boilerplate container). A
decision tree, grown here from the labelled table ``EXAMPLES`` and the labelled blocks of
``EXAMPLE_PAGES``, keeps or drops each block.
Pages are independent, so the operator is one map over the table without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Left out with all they hold; without an end tag the first four go on to the end of the page, the others hold nothing.
RAW_TEXT = frozenset("script style title iframe noscript template svg math object canvas audio video".split())
ENDLESS = frozenset("script style title iframe".split())
FORM_PARTS = frozenset("form button select option textarea label fieldset input datalist output dialog".split())
CHROME = frozenset("nav header footer aside menu".split()) | FORM_PARTS
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = (
    CHROME
    | ARTICLE
    | HEADINGS
    | frozenset(
        "html body p div section ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary center hgroup legend".split()
    )
) - frozenset(("input",))
VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
#: An opening tag of these closes an open one of the same kind on top of the stack.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split()) | HEADINGS
#: Words of a class, id or role that mark a container as no part of an article, where all of its words are these or neutral.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside complementary widget footer contentinfo header masthead topbar toolbar comment comments commentlist reply replies respond discussion "
    "cookie cookies consent notice alert popup modal dialog overlay newsletter subscribe subscription signup share sharing social related recommended "
    "pagination pager login search copyright legal disclaimer skip hidden byline".split()
)
NEUTRAL_WORDS = frozenset(
    "list item items box wrapper wrap container bar block inner outer section area panel links link buttons button icons icon site global main primary "
    "secondary top bottom left right posts articles stories text form message js has is the my".split()
)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""=["']|>""")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "in_article", "in_boiler")
#: One row a block: the features above, then 1 for main text. Fixed values, labelled by hand.
EXAMPLES = (
    # paragraphs inside an article, long and short, at its edges too
    (60, 0.00, 8, 0.00, 70, 0.00, 0, 1, 0, 1),
    (120, 0.05, 60, 0.00, 40, 0.00, 0, 1, 0, 1),
    (2, 0.00, 60, 0.00, 80, 0.00, 0, 1, 0, 1),
    (1, 0.00, 5, 0.00, 2, 0.00, 0, 1, 0, 1),
    (9, 0.30, 30, 0.00, 30, 0.10, 0, 1, 0, 1),
    (45, 0.00, 50, 0.00, 6, 1.00, 0, 1, 0, 1),
    (4, 0.00, 90, 0.00, 9, 0.20, 0, 1, 0, 1),
    (300, 0.02, 7, 0.00, 0, 0.00, 0, 1, 0, 1),
    (3, 0.00, 1, 1.00, 200, 0.00, 0, 1, 0, 1),
    # headings of an article
    (6, 0.00, 1, 1.00, 60, 0.00, 1, 1, 0, 1),
    (8, 0.00, 8, 0.00, 7, 0.00, 1, 1, 0, 1),
    (3, 0.00, 80, 0.00, 50, 0.00, 1, 1, 0, 1),
    (5, 0.00, 2, 0.00, 0, 0.00, 1, 1, 0, 1),
    # lists of links inside an article
    (4, 1.00, 60, 0.00, 5, 1.00, 0, 1, 0, 0),
    (6, 0.90, 4, 1.00, 4, 1.00, 0, 1, 0, 0),
    (12, 0.95, 80, 0.00, 10, 0.95, 0, 1, 0, 0),
    (3, 1.00, 2, 1.00, 2, 0.00, 0, 1, 0, 0),
    (5, 1.00, 70, 0.00, 0, 0.00, 0, 1, 0, 0),
    (2, 1.00, 40, 0.00, 3, 0.00, 0, 1, 0, 0),
    (8, 0.95, 30, 0.00, 60, 0.00, 0, 1, 0, 0),
    # containers that are never part of one, inside an article or not
    (40, 0.00, 30, 0.00, 20, 0.00, 0, 1, 1, 0),
    (8, 0.00, 70, 0.00, 60, 0.00, 0, 1, 1, 0),
    (150, 0.00, 90, 0.00, 40, 0.00, 0, 1, 1, 0),
    (3, 0.00, 40, 0.00, 30, 0.00, 1, 1, 1, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 1, 0),
    (8, 0.00, 1, 1.00, 6, 0.00, 0, 0, 1, 0),
    (7, 0.00, 50, 0.00, 0, 0.00, 0, 0, 1, 0),
    (80, 0.00, 10, 0.00, 10, 0.00, 0, 0, 1, 0),
    (30, 0.20, 60, 0.00, 0, 0.00, 0, 0, 1, 0),
    (5, 0.00, 1, 1.00, 40, 0.00, 1, 0, 1, 0),
    # pages without an article element: long text stays, chrome goes
    (60, 0.00, 3, 1.00, 70, 0.00, 0, 0, 0, 1),
    (30, 0.05, 60, 0.00, 50, 0.00, 0, 0, 0, 1),
    (16, 0.10, 40, 0.00, 8, 0.50, 0, 0, 0, 1),
    (200, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1),
    (90, 0.30, 10, 0.00, 2, 1.00, 0, 0, 0, 1),
    (4, 0.00, 60, 0.00, 70, 0.00, 0, 0, 0, 1),
    (2, 0.00, 40, 0.00, 30, 0.00, 0, 0, 0, 1),
    (8, 0.00, 35, 0.00, 90, 0.10, 0, 0, 0, 1),
    (6, 0.00, 2, 1.00, 60, 0.00, 1, 0, 0, 1),
    (5, 0.00, 4, 0.00, 35, 0.00, 1, 0, 0, 1),
    (3, 0.00, 70, 0.00, 45, 0.00, 1, 0, 0, 1),
    (40, 0.00, 60, 0.00, 5, 0.00, 0, 0, 0, 1),
    (25, 0.00, 45, 0.00, 6, 0.30, 0, 0, 0, 1),
    (70, 0.00, 30, 0.00, 3, 1.00, 0, 0, 0, 1),
    (20, 0.05, 7, 0.00, 0, 0.00, 0, 0, 0, 1),
    (15, 0.00, 28, 0.00, 4, 0.80, 0, 0, 0, 1),
    (13, 0.00, 45, 0.00, 7, 0.00, 0, 0, 0, 1),
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0),
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0),
    (25, 0.90, 2, 1.00, 3, 1.00, 0, 0, 0, 0),
    (60, 0.95, 3, 1.00, 2, 1.00, 0, 0, 0, 0),
    (5, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0),
    (8, 0.00, 1, 1.00, 6, 0.00, 0, 0, 0, 0),
    (6, 0.00, 3, 0.00, 4, 0.50, 0, 0, 0, 0),
    (7, 0.20, 60, 0.00, 0, 0.00, 0, 0, 0, 0),
    (4, 0.00, 5, 0.50, 2, 0.00, 0, 0, 0, 0),
    (3, 0.00, 0, 0.00, 4, 1.00, 1, 0, 0, 0),
    (3, 0.00, 2, 1.00, 5, 1.00, 1, 0, 0, 0),
)


#: Small pages with labelled blocks: [+n] is a block of n words that is main text, [-n] one that is not, [~n] n words more.
EXAMPLE_PAGES = (
    # pages without an article element: short answers, lists, poems and tables are text where no links are near
    "<p>[+1]</p><p>[+1]</p><p>[+1]</p>",
    "<p>[+2]</p><p>[+3]</p><p>[+1]</p><p>[+4]</p>",
    "<ul><li>[+1]</li><li>[+1]</li><li>[+1]</li></ul>",
    "<h1>[+3]</h1><ul><li>[+1]</li><li>[+2]</li><li>[+1]</li><li>[+5]</li></ul>",
    "<h2>[+2]</h2><p>[+5]</p><p>[+6]</p><p>[+5]</p><p>[+7]</p>",
    "<table><tr><td>[+1]</td><td>[+2]</td></tr><tr><td>[+1]</td><td>[+3]</td></tr></table>",
    "<p>[+30]</p><ul><li>[+2]</li><li>[+3]</li><li>[+1]</li></ul><p>[+50]</p>",
    "<dl><dt>[+1]</dt><dd>[+12]</dd><dt>[+2]</dt><dd>[+9]</dd></dl>",
    "<p>[+8]</p>",
    "<h1>[+4]</h1><p>[+9]</p><p>[+10]</p>",
    # the same with menus before and links after them
    "<div><a>[-1]</a></div><div><a>[-1]</a></div><div><a>[-2]</a></div><h1>[+5]</h1><p>[+40]</p><p>[+3]</p><p>[+60]</p><div><a>[-2]</a></div>",
    "<ul><li><a>[-1]</a><li><a>[-1]</a><li><a>[-1]</a></ul><p>[+25]</p><p>[+35]</p><p>[-6]</p><ul><li><a>[-2]</a><li><a>[-3]</a></ul>",
    "<div>[-2]<a>[~3]</a></div><p>[+80]</p><h2>[+3]</h2><p>[+45]</p><p>[+20]<a>[~2]</a></p><div><a>[-4]</a></div><div>[-5]</div>",
    "<div><a>[-2]</a></div><div>[-3]</div><div><a>[-1]</a></div><p>[+70]</p><div>[-4]</div><div><a>[-1]</a></div>",
    # article elements with short blocks, a menu and a footer around them
    "<nav><a>[-1]</a> <a>[~1]</a></nav><article><h1>[+6]</h1><p>[+2]</p><p>[+1]</p><p>[+90]</p><ul><li>[+1]</li><li>[+2]</li></ul></article><footer>[-8]</footer>",
    "<header>[-2]</header><main><h1>[+5]</h1><p>[+15]<a>[~4]</a></p><p><a>[-6]</a></p><p>[+30]</p><aside>[-40]</aside></main><footer>[-12]</footer>",
    "<div class='ad'>[-9]</div><article><h1>[+3]</h1><p>[+7]</p><div class='ad'>[-30]</div><p>[+50]</p></article><section id='comments'><p>[-45]</p></section>",
)
MARKER = re.compile(r"\[([-+~])(\d+)\]")


def labelled_blocks(page: str) -> list[tuple]:
    """One row a block of an example page: its features and its label."""
    text = MARKER.sub(lambda m: " ".join([{"+": "yes", "-": "no", "~": "more"}[m[1]]] + ["word"] * (int(m[2]) - 1)), page)
    blocks = flat_blocks(text)
    return [(*row, int(block[0].startswith("yes"))) for block, row in zip(blocks, features(blocks))]


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2.0 * p * (1.0 - p)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A decision tree by least Gini impurity: ``(feature, cut, below, above)`` or ``(label,)``.

    Ties go to the first feature and the lowest cut, so the same table grows the same tree.
    """
    if depth == 0 or len(set(y.tolist())) == 1:
        return (int(y.mean() >= 0.5),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < cut
            cost = left.mean() * _gini(y[left]) + (~left).mean() * _gini(y[~left])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), left)
    if best is None or best[0] >= _gini(y) - 1e-12:
        return (int(y.mean() >= 0.5),)
    _, f, cut, left = best
    return (f, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def decide(tree: tuple, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0]


@lru_cache(maxsize=1)
def default_tree() -> tuple:
    table = np.array([*EXAMPLES, *[r for page in EXAMPLE_PAGES for r in labelled_blocks(page)]], dtype=float)
    return grow(table[:, :-1], table[:, -1])


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Index of the ``>`` that ends the tag at ``at``, quotes heeded; -1 if there is none.

    Where no ``>`` outside quotes follows, it is the first one. ``dead`` holds the opening quotes
    of the page after which there is none, so that each is passed once.
    """
    first = page.find(">", at)
    if first < 0 or (page.count('"', at, first) % 2 == 0 and page.count("'", at, first) % 2 == 0):
        return first
    passed, pos = [], at
    while (found := STOP.search(page, pos)) and found[0] != ">" and found.start() not in dead:
        passed.append(found.start())
        pos = page.find(found[0][1], found.end()) + 1
        if not pos:
            break
    else:
        if found and found[0] == ">":
            return found.start()
    dead.update(passed)
    return first


def _is_boiler(attributes: str) -> bool:
    if HIDDEN.search(attributes):
        return True
    for m in CLASS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = {w.lower() for w in WORD_PARTS.findall(name)}
            if parts & BOILER_WORDS and parts <= BOILER_WORDS | NEUTRAL_WORDS:
                return True
    return False


def flat_blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """``(text, words, link density, heading, in_article, in_boiler)`` of each block, in page order."""
    blocks: list = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, int]] = []  # tag, in an article, in boilerplate
    links = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(p.split()) for p, in_link in parts if in_link)
                _, article, boiler = stack[-1] if stack else ("", 0, 0)
                heading = int(any(t in HEADINGS for t, _, _ in stack[-2:]))
                if heading and boiler and article and sum(t == "header" for t, _, _ in stack) and boiler == 1:
                    boiler = 0  # the headline in an article's own header
                blocks.append((text, words, min(1.0, linked / words), heading, article, int(boiler > 0)))
            parts.clear()

    pos, n, dead = 0, len(page), set()
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            parts.append((entities.unescape(page[pos:at]), links > 0))
        if at == n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", at)
        name = NAME.match(page, at + 1 + closing)
        if not name:
            parts.append(("<", links > 0))
            pos = at + 1
            continue
        tag = name[0].lower()
        end = _tag_end(page, name.end(), dead)
        if end < 0:
            break  # a page that was cut off inside a tag
        attributes = page[name.end() : end]
        pos = end + 1
        if tag in RAW_TEXT:
            if not closing and not attributes.endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                pos = shut.end() if shut else n if tag in ENDLESS else pos
            continue
        if tag == "br":
            parts.append((" ", links > 0))
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCKS:
            flush()
            if closing:
                links = 0
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag not in VOID:
                if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
                    stack.pop()
                elif tag not in SELF_CLOSING and stack and stack[-1][0] == "p":
                    stack.pop()
                _, article, boiler = stack[-1] if stack else ("", 0, 0)
                if tag in ARTICLE:
                    article = 1
                own = tag in FORM_PARTS or tag in ("nav", "footer", "aside", "menu")
                if own or (tag not in ("html", "body", "main", "article") and attributes and _is_boiler(attributes)):
                    boiler = 2
                elif tag == "header" and not boiler:
                    boiler = 1
                stack.append((tag, article, boiler))
    flush()
    return blocks


def features(blocks: list[tuple]) -> list[tuple]:
    """The row of ``FEATURES`` of each block of a page."""
    rows = []
    for i, (_, words, links, heading, article, boiler) in enumerate(blocks):
        before = blocks[i - 1] if i else (None, 0, 0.0)
        after = blocks[i + 1] if i + 1 < len(blocks) else (None, 0, 0.0)
        rows.append((words, links, before[1], before[2], after[1], after[2], heading, article, boiler))
    return rows


def main_text(page: str | None, tree: tuple | None = None) -> str:
    """Blocks that the tree keeps, joined by a blank line; ``""`` for a null or empty page."""
    if not page:
        return ""
    tree = tree or default_tree()
    blocks = flat_blocks(page)
    kept = [block[0] for block, row in zip(blocks, features(blocks)) if decide(tree, row)]
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text``: the main text of each page's ``html``. A column of that name is replaced.

    Every row comes back once, repeated rows too, also from an empty table. Null and empty
    pages have the text ``""``; a page of any length is read whole, in one pass. Extra
    columns pass through, whatever their names.
    """

    def extract(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = default_tree()
        for s in series:
            yield pd.Series([main_text(x, tree) for x in s], dtype=object)

    return pages.withColumn(text, F.pandas_udf(extract, "string")(F.col(html)))


def page_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns: page_id, url, text, n_chars."""
    made = extract_main_text(pages.select("page_id", "url", "html"))
    return made.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
