"""Main text of web pages by composite text density.

For every node of the page its characters per tag are worked out, adjusted for how many
of them are links.  The node whose children's densities have the largest sum holds the
article; the smallest density on its way up to the body is the threshold from which
other parts of the page count as content too.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup language: elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
LISTS = frozenset("div section ul ol table".split())
CONTAINER = frozenset("article body div main section td html".split())
#: Elements that never hold the article, and those that don't unless they stand in it.
NOISE = frozenset("nav aside form button select footer dialog menu svg canvas audio video object".split())
OUTER_NOISE = frozenset(["header"])
#: An open element that one of these start tags closes.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: What these rules look for, and what they don't look beyond.
_MARKED = frozenset({"p", "blockquote", "form", "aside", "nav", "dl", "select"}) | LISTS | CONTAINER | frozenset().union(CLOSES, *CLOSES.values())
#: Controls, which hold no article whatever their share of the text.
CONTROLS = frozenset("button select menu svg canvas audio video object".split())
#: Share of a page's text outside links from which a part is kept whatever its name.
MOST = 0.5
#: Words that mark menus, notices, adverts and comments where a class, id or role consists of
#: them, such as cookie-notice; words that add nothing may stand between them.
_NOISE = (
    "ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion"
    "|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|footer|masthead|cookie|cookies"
    "|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related"
    "|recommended|comment|comments|disqus|respond|reply|replies|pagination|pager|toolbar|search|copyright"
)
_NEUTRAL = (
    "page|site|wrap|wrapper|box|bar|block|widget|container|section|area|list|item|items|link|links|post|posts"
    "|form|button|buttons|icons|slot|unit|top|bottom|left|right|primary|secondary|global|inner|outer|[0-9]+"
)


def _consists_of(words: str) -> re.Pattern:
    other = rf"(?:(?:{_NEUTRAL})[_-]+)*"
    return re.compile(rf"(?<!\S){other}(?:{words})(?:[_-]+(?:{words}|{_NEUTRAL}))*(?!\S)", re.I)


NOISE_WORDS = _consists_of(_NOISE)
#: Words that may as well be what a part of the article is about; its text decides there.
TOPIC_WORDS = _consists_of("share|sharing|social|related|recommended|search|promotion|copyright")
_SENTENCE = re.compile(r"[.!?…。!?](?:[\s\"'”’)»]|\Z)")
#: Words that do so outside the article only.
OUTER_WORDS = _consists_of("header|topbar")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.S,
)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
#: A tag that the page ends in: no text, as in browsers.
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_MARKS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Page:
    """Nodes in page order: parents come before their children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop = ["html"], [-1], [False]
        # Nodes that are dropped by their own tag or names, and of these the ones that have text to read.
        self.own, self.named = [False], [False]
        # Nodes inside an article, and those there whose names may be their topic.
        self.inside, self.topic = [False], [False]
        #: Places in the stack of open elements that can be closed by others or end the search for them.
        self.marked: list[int] = []
        # Pieces of text as (node, text); None for a block's edge.
        self.pieces: list[tuple[int, str | None]] = []
        self._read(source)
        self._keep_topics()
        self._keep_most()

    def _open(self, tag: str, attrs: str, stack: list[int]) -> None:
        if tag in CLOSES:
            self._close_first(CLOSES[tag], stack, CLOSES[tag] | {"ul", "ol", "table", "dl", "select"})
        if tag in BLOCK:
            self._close_first({"p"}, stack, CONTAINER | {"li", "blockquote", "table", "ul", "ol", "form", "aside", "nav"})
        if tag in ("article", "main") and self.drop[stack[-1]]:
            while len(stack) > 1 and self.drop[stack[-1]]:  # the article can't be in a menu left open
                stack.pop()
            while self.marked and self.marked[-1] >= len(stack):
                self.marked.pop()
        node = len(self.tag)
        inside = self.inside[stack[-1]] or self.tag[stack[-1]] in ("article", "main")
        drop = tag in NOISE or (tag in OUTER_NOISE and not inside)
        hidden = topic = False
        if attrs and tag not in ("html", "body", "article", "main"):
            # The id of a heading, or of a section of the article, tells what it is about.
            plain = tag in HEADINGS or (tag == "section" and inside)
            found = _MARKS.findall(attrs)
            marks = " ".join(a or b or c for name, a, b, c in found if not (plain and name.lower() == "id"))
            hidden = bool(_HIDDEN.search(attrs))
            named = bool(marks and (NOISE_WORDS.search(marks) or (not inside and OUTER_WORDS.search(marks))))
            topic = named and not drop and not hidden and inside and not NOISE_WORDS.search(TOPIC_WORDS.sub("", marks))
            drop = drop or named
        self.inside.append(inside)
        self.topic.append(topic)
        self.own.append(drop or hidden)
        self.named.append(drop and not hidden and tag not in CONTROLS)
        drop = drop or hidden or self.drop[stack[-1]]
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.drop.append(drop)
        if tag in BLOCK:
            self.pieces.append((node, None))
        if tag == "br":
            self.pieces.append((node, " "))
        if tag not in VOID:
            if tag in _MARKED:
                self.marked.append(len(stack))
            stack.append(node)

    def _keep_topics(self) -> None:
        """Keep parts of the article that are named like noise, but hold sentences or a list and few links."""
        if not any(self.topic):
            return
        n = len(self.tag)
        chars, links, said = [0] * n, [0] * n, [False] * n
        for node, text in self.pieces:
            if text:
                chars[node] += len(text.strip())
                said[node] = said[node] or bool(_SENTENCE.search(text))
        for i in range(n - 1, 0, -1):
            links[i] = chars[i] if self.tag[i] == "a" else links[i]
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            said[p] = said[p] or (said[i] and self.tag[i] != "a")
        for i in range(1, n):
            if self.topic[i] and 2 * links[i] <= chars[i] and (said[i] or self.tag[i] in ("ul", "ol", "dl", "table")):
                self.own[i] = self.named[i] = False
            self.drop[i] = self.drop[self.parent[i]] or self.own[i]

    def _keep_most(self) -> None:
        """Keep parts dropped by name that hold most of the page's text, unless an article stands elsewhere."""
        n = len(self.tag)
        if not any(self.named):
            return
        gone = [o and not m for o, m in zip(self.own, self.named)]
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]] or self.tag[i] == "a"
        chars, articles = [0] * n, [0] * n
        for node, text in self.pieces:
            if text and not gone[node]:
                chars[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if chars[i] and not self.drop[i] and self.tag[i] in ("article", "main"):
                articles[i] = 1
            chars[self.parent[i]] += chars[i]
            articles[self.parent[i]] += articles[i]
        for i in range(1, n):
            most = self.named[i] and chars[i] > MOST * chars[0] and articles[i] == articles[0]
            self.drop[i] = self.drop[self.parent[i]] or (self.own[i] and not most)

    def _close_first(self, tags, stack: list[int], fence) -> None:
        """Close the nearest open element of ``tags`` that no element of ``fence`` hides."""
        for at in reversed(self.marked):
            name = self.tag[stack[at]]
            if name in tags:
                self._pop_to(at, stack)
                return
            if name in fence:
                return

    def _pop_to(self, at: int, stack: list[int]) -> None:
        while len(stack) > at:
            node = stack.pop()
            if self.marked and self.marked[-1] == len(stack):
                self.marked.pop()
            if self.tag[node] in BLOCK:
                self.pieces.append((node, None))

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        last = source.rfind(">")
        count: dict[str, int] = {}
        while at < n:
            # After the last tag only an open comment can follow.
            m = _TOKEN.search(source, at) if at <= last else _OPEN_COMMENT.search(source, at)
            text = source[at : m.start() if m else n]
            if not m:
                text = _UNFINISHED.sub("", text)
            if text:
                self.pieces.append((stack[-1], text))
            if not m:
                break
            at = m.end()
            tag = "" if m.re is _OPEN_COMMENT else (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["end"] or m["end2"]:
                if count.get(tag):
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[i]] == tag:
                            self._pop_to(i, stack)
                            break
                    else:
                        count[tag] = 0
                continue
            attrs = m["attrs"] or ""
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = source.find(">", end.end() - 1) + 1 if end and source.find(">", end.end() - 1) >= 0 else n
                continue
            if tag in ("html", "body") and count.get(tag):
                continue
            count[tag] = count.get(tag, 0) + 1
            self._open(tag, attrs, stack)


def densities(page: Page) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite density of every node, the sum of its children's, its characters, those of links."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.pieces:
        if text and not page.drop[node]:
            chars[node] += len(text.strip())
    for i in range(n - 1, 0, -1):
        if page.drop[i]:
            continue
        if page.tag[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        p = page.parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i] + 1
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i]
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    all_chars, all_links = max(chars[body], 1), link_chars[body]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
        if c:
            base = math.log(c / max(c - link_chars[i], 1) * link_chars[i] + all_links / all_chars * c + math.e)
            density[i] = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / base, 0.0)
        if i:
            total[page.parent[i]] += density[i]
    return density, total, chars, link_chars


def content_roots(page: Page) -> set[int]:
    """Nodes whose text is content; outside articles, parts that are mostly links are dropped."""
    density, total, chars, links = densities(page)
    best = max(range(len(page.tag)), key=lambda i: (total[i], density[i]))
    if not chars[0]:
        return set()
    # Paragraphs and inline marks are parts of an article: go up to what holds them.
    up = best
    while page.parent[up] >= 0 and page.tag[up] not in CONTAINER:
        up = page.parent[up]
    path, node = [], best
    while node >= 0:
        path.append(node)
        if page.tag[node] == "body":
            break
        node = page.parent[node]
    threshold, on_path = min(density[i] for i in path), set(path)
    root = next((i for i in path[::-1] if page.tag[i] in ("article", "main")), up)
    if page.tag[root] not in ("article", "main"):
        for i, tag in enumerate(page.tag):
            if i not in on_path and tag in LISTS and 2 * links[i] > chars[i]:
                page.drop[i] = True
    roots, inside = {root}, [False] * len(page.tag)
    for i in range(len(page.tag)):
        p = page.parent[i]
        inside[i] = i == root or (p >= 0 and inside[p])
        # Other containers as dense as the way to the article, such as further sections.
        if not inside[i] and i not in on_path and page.tag[i] in CONTAINER and density[i] >= threshold > 0 and not page.drop[i]:
            roots.add(i)
            inside[i] = True
    return roots


def extract(source: str | None) -> str:
    """The article's blocks in page order, one to a line; empty for null and empty pages."""
    if not source:
        return ""
    page = Page(source)
    roots = content_roots(page)
    kept = [False] * len(page.tag)
    for i in range(len(page.tag)):
        p = page.parent[i]
        page.drop[i] |= p >= 0 and page.drop[p]
        kept[i] = not page.drop[i] and (i in roots or (p >= 0 and kept[p]))
    blocks, run = [], []
    for node, text in [*page.pieces, (0, None)]:
        if text is None:
            block = " ".join(entities.unescape("".join(run)).split())
            if block:
                blocks.append(block)
            run = []
        elif kept[node]:
            run.append(text)
    return "\n".join(blocks)


def _extract_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for sources in batches:
        yield sources.map(extract, na_action=None).astype(object)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the columns ``text`` and ``n_chars``.

    A null or empty page, and one without an article, has an empty text of 0 characters.
    Each row is worked out alone: repeated rows, null ids and empty tables need nothing
    special.  Columns named text or n_chars are replaced, others kept.
    """
    with_text = pages.withColumn("text", F.pandas_udf(_extract_all, "string")(F.col(html)))
    return with_text.withColumn("n_chars", F.length("text").cast("long"))


def op9(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return main_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
