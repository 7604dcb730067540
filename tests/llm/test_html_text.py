"""Main text of pages: small pages with known articles, and the given pages."""

import math
import random
import re
import time

import pytest

from tidemill.llm import html_text
from tidemill.llm.html_text import extract, main_text

LONG = "Some longer sentence of the article, with commas, and so on. " * 3


def test_parts_that_are_left_out():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='<p>no</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><div id=page-header>Welcome to the site</div><div class=\"ad\">Buy now</div>"
        f"<article class='side-by-side'><header><h1>Head&amp;line</h1></header><p>{LONG}<p>Two&nbsp;  words\n<b>bold</b><br>next"
        "<form><input><button>Send</button></form><ul><li>one<li>two</ul><!-- <p>hidden</p> --></article>"
        f"<section class='comments'><p>{LONG}</p></section><aside>{LONG}</aside><footer>&copy; me</footer></body></html>"
    )
    assert extract(page) == "\n".join(["Head&line", LONG.strip(), "Two words bold next", "one", "two"])


def test_no_article_element_and_sections():
    assert extract(f"<body><div id=main><p>{LONG}</p><p>short</p></div><div class=sidebar>x</div></body>") == f"{LONG.strip()}\nshort"
    got = extract(f"<body><div><h2>A</h2><p>{LONG}</p></div><div><h2>B</h2><p>{LONG}</p></div><div><a href=1>l</a> <a href=2>m</a></div></body>")
    assert got == f"A\n{LONG.strip()}\nB\n{LONG.strip()}"


def test_parts_with_names_of_noise():
    """What holds most of the text stays, as do names that only contain a word for noise."""
    body = f"<h1>Head</h1><p>{LONG}</p>"
    want = f"Head\n{LONG.strip()}"
    form = f"<body><form id=aspnetForm><nav><a href=x>menu</a></nav><div id=c>{body}<button>Send</button></div><footer>me</footer></form></body>"
    assert extract(form) == want
    for name in ("content-sidebar-wrap", "has-sidebar", "sidebar"):
        assert extract(f"<body><div class='{name}'><div>{body}</div></div><div class=sidebar>x</div></body>") == want, name
    inner = f"<section id='related-work'><h2 id='search-algorithms'>A</h2><p>{LONG}</p><h3 id=search>B</h3><p>{LONG}</p></section>"
    assert extract(f"<article>{inner}<div class='related-posts'>x</div></article>") == f"A\n{LONG.strip()}\nB\n{LONG.strip()}"
    short = f"<body><article><p>Short one.</p></article><section class='comments'><p>{LONG}</p></section></body>"
    assert extract(short) == "Short one."


def test_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<!-- open", "<script>x", "<nav><a href='", "</p></div>"):
        assert extract(page) in ("", "<"), page
    # A tag that the page ends in is no text; a sign that begins none is.
    assert extract(f'<article><p>{LONG}<p>cut <div class="x"') == f"{LONG.strip()}\ncut"
    assert extract("<p>1 < 2 and 3 <4") == "1 < 2 and 3 <4" and extract("<p>a <!-- b <i") == "a"
    assert extract("plain words") == "plain words"
    assert extract("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"
    assert len(extract("<body><article>" + "<p>word word</p>" * 30_000 + "</article>").split("\n")) == 30_000


def test_names_inside_the_article():
    """Parts whose names may be what they are about stay if they hold sentences, or a list, and few links."""
    inner = '<section class="social"><p>On social effects of things.</p></section><ul class="related-items"><li>one<li>two</ul>'
    noise = (
        '<div class="share">Share this <a href=x>there</a></div><div class="related"><a href=x>Another article.</a></div>'
        f'<div class="comments"><p>{LONG}</p></div><div class="newsletter">Subscribe now. It is free.</div>'
        '<div class="social ad">Buy it now.</div><ul class="related"><li><a href=1>Some link.</a></ul>'
    )
    for element in ("article", "main"):
        assert extract(f"<body><{element}><p>{LONG}</p>{inner}{noise}<p>End.</p></{element}></body>") == (
            f"{LONG.strip()}\nOn social effects of things.\none\ntwo\nEnd."
        )
    assert extract(f'<body><div><p>{LONG}</p></div><section class="social"><p>On social effects.</p></section></body>') == LONG.strip()


@pytest.mark.parametrize("tags", ["<font>", "<div>", "<p><b>", "<li><font>", "<b><hr>", "<p><div><font>", '<section class="social">', '<a "', "<a x='>"])
def test_many_open_tags_take_linear_time(tags):
    started = time.process_time()
    extract("<body><article>" + tags * 100_000 + "text")
    assert time.process_time() - started < 30  # some seconds; hours if every tag looked at all others


def plain_densities(page):
    """Composite text density, node by node from its own subtree."""
    n = len(page.tag)
    children = [[c for c in range(n) if page.parent[c] == i] for i in range(n)]
    below = lambda i: [i] + [x for c in children[i] if not page.drop[c] for x in below(c)]
    text = lambda nodes: sum(len(t.strip()) for k, t in page.pieces if t and k in nodes and not page.drop[k])
    links = lambda i: [x for x in below(i) if page.tag[x] == "a" and not any(
        page.tag[y] == "a" and x in below(y) and x != y for y in below(i))]
    body = page.tag.index("body") if "body" in page.tag else 0
    lb, cb = sum(text(below(x)) for x in links(body)), max(text(below(body)), 1)
    out = []
    for i in range(n):
        c, t = text(below(i)), max(len(below(i)) - 1, 1)
        lc, lt = sum(text(below(x)) for x in links(i)), len([x for x in below(i) if page.tag[x] == "a"])
        if not c or page.drop[i]:
            out.append(0.0)
            continue
        base = math.log(c / max(c - lc, 1) * lc + lb / cb * c + math.e)
        out.append(c / t * max(math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base, 0.0))
    return out, [sum(out[c] for c in children[i]) for i in range(n)]


def test_densities_equal_the_plain_formula():
    rng = random.Random(2)
    for _ in range(60):
        parts, open_tags = ["<body>"], []
        for _ in range(rng.randint(1, 25)):
            tag = rng.choice(["div", "p", "b", "a", "section", "nav", "span"])
            if tag == "a" and "a" in open_tags:
                tag = "i"  # links don't stand in links
            parts.append(f"<{tag}>" + "word " * rng.randint(0, 6))
            open_tags.append(tag)
            while open_tags and rng.random() < 0.5:
                parts.append(f"</{open_tags.pop()}>" + rng.choice(["", "tail"]))
        page = html_text.Page("".join(parts))
        density, total, _, _ = html_text.densities(page)
        want, sums = plain_densities(page)
        assert density == pytest.approx(want) and total == pytest.approx(sums)


def test_given_pages(spark, sf_dir):
    """The plain path: the article element, its tags cut out."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<(?:/?p|/?h1)>", "\x00", inner).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in inner.split("\x00")]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", "<article><p>a b</p></article>"), (1, "u", "<article><p>a b</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' as text", "5 as n_chars")
    assert sorted((r.text, r.n_chars) for r in main_text(df).collect()) == [("", 0), ("", 0), ("a b", 3), ("a b", 3)]
    assert main_text(df.limit(0)).count() == 0
