import random

from engram.llm import html_extract as hx

RNG = random.Random(9)


def prose(n):
    return " ".join(f"word{RNG.randrange(500)}" for _ in range(n)) + "."


def test_tree_fits_its_table():
    tree = hx.default_tree()
    rows = [*hx.EXAMPLES, *[r for page in hx.EXAMPLE_PAGES for r in hx.labelled_blocks(page)]]
    wrong = [r for r in rows if hx.decide(tree, r[:-1]) != r[-1]]
    assert len(rows) > 130 and len(wrong) <= 3, wrong

    def used(t):
        return set() if len(t) == 1 else {hx.FEATURES[t[0]]} | used(t[2]) | used(t[3])

    assert {"links", "words", "links_before", "links_after"} <= used(tree)


def test_short_blocks_and_honest_names():
    join = "\n\n".join
    assert hx.main_text("<p>Yes.</p><p>No.</p><p>Yes.</p>") == join(["Yes.", "No.", "Yes."])
    assert hx.main_text("<ul><li>milk</li><li>bread</li><li>eggs</li></ul>") == join(["milk", "bread", "eggs"])
    a, b = prose(40), prose(30)
    assert hx.main_text(f"<html><head><title>T</title><body><article><p>{a}</p></article>") == a
    assert hx.main_text(f"<html><head><meta charset=x><p>{a}</p>") == a
    for name in ("related-work", "search-methods", "header-image-post", "social-history", "post-header"):
        assert hx.main_text(f'<body><section class="{name}"><h2 id="social-history">Two words</h2><p>{a}</p><p>{b}</p></section>') == join(["Two words", a, b])
    for name in ("ad", "site-header", "cookieNotice", "share-buttons", "related-posts", "comment-list", "top ad"):
        assert hx.main_text(f'<article><p>{a}</p><div class="{name}"><p>{b}</p></div></article>') == a
    assert hx.main_text(f"<article><p>{a}</p><svg><p>{b}</p></article>") == join([a, b])


def test_article_page_with_everything_else():
    a, b, c = prose(40), prose(3), prose(90)
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = "</p><p>no";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">a</a><li><a href="/b">b</a></ul></nav><div class="cookie-notice"><p>{prose(30)}</p></div>
<main><article><header><h1>The  Head&amp;line</h1><p class="byline">By me</p></header><p><b>{a}</b><br>x&nbsp;y<p>{b}<div class="ad">{prose(25)}</div><!-- c --><p>{c} <a href="/x">link</a> end</p>
<aside>{prose(40)}</aside><form><label>Mail</label><input name=q value="a > b"><button>Go</button></form></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>{prose(50)}</p></div></section></main>
<div class="sidebar"><p>{prose(35)}</p></div><footer>&copy; 2020 {prose(10)}</footer></body></html>"""
    assert hx.main_text(page) == f"The Head&line\n\n{a} x y\n\n{b}\n\n{c} link end"


def test_page_without_article_element():
    a, b = prose(60), prose(45)
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><h1>Heading here now</h1><div><p>{a}</p><p>{b}</p></div><div><a href=3>more links</a></div><p>Imprint</p></body>"
    assert hx.main_text(page) == f"Heading here now\n\n{a}\n\n{b}"


def test_broken_markup():
    assert hx.main_text(None) == hx.main_text("") == hx.main_text("<p") == ""
    text = prose(30)
    assert hx.main_text(f"<article><p>{text} &am") == f"{text} &am"
    assert hx.main_text(f"<article><p title='x > y'>{text}<p") == text
    assert hx.main_text(f"<article><p>{text} 3 < 4 &#233; &lt;b&gt;</p>") == f"{text} 3 < 4 é <b>"
    assert hx.main_text("<script>never closed <p>" + text) == ""
    assert len(hx.main_text("<article>" + "<p>a b c" * 20_000)) == 20_000 * 7 - 2


def test_long_quoted_values():
    a, b = prose(40), prose(40)
    for n in (10, 19_000, 25_000, 200_000):
        value = f"<p>{prose(30)}</p>" + "x" * n
        assert hx.main_text(f"<article><p>{a}</p><p data-props='{value}' class=\"c\">{b}</p></article>") == f"{a}\n\n{b}"
    dead = set()
    page = '<p ="x" =">' * 20_000
    assert [hx._tag_end(page, i + 2, dead) for i in range(0, len(page), 11)] == list(range(10, len(page), 11))


def test_operator(spark, tiny):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "<article><p>é 😀 text</article>", "t"), (2, "u", "<article><p>é 😀 text</article>", "t")], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in hx.page_digest(pages).orderBy("page_id").collect()]
    assert got == [(1, "u", "", 0), (2, "u", "é 😀 text", 8), (2, "u", "é 😀 text", 8)]
    assert hx.page_digest(pages.limit(0)).count() == 0
    table = spark.read.parquet(f"{tiny}/pages.parquet")
    import re

    def plainly(html):
        inside = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
        parts = [" ".join(hx.entities.unescape(x).split()) for x in re.split(r"<(?:/?(?:p|h1)|br)>", re.sub(r"</?b>", "", inside))]
        return "\n\n".join(x for x in parts if x)

    want = {r.page_id: plainly(r.html) for r in table.collect()}
    assert {r.page_id: r.text for r in hx.page_digest(table).collect()} == want
