"""Main-text extraction from HTML by tree scoring.

Paragraphs earn points for their length and commas; a paragraph's points go to its parent whole, to the next
ancestor by half, and on by a third a level; a container's points are discounted by its link density.  The best
container and those of its siblings that score well, are headings or hold unmarked prose are kept, and their blocks are
the text; lists of links are menus but inside a container that is marked as the article.  Points are handed up
in one pass, so a page takes time and memory in proportion to its own length.

Elements that are never the article (menus, headers, footers, forms, scripts; also ``math``, ``object`` and ``template``,
whose content isn't read text) are left out.  Words in class, id and
role that speak against a container weigh against how much of the page's unlinked text it holds: such a container is
left out unless it also has a word that speaks for it and holds ``SOME`` of that text (not so for readers' comments),
or it holds ``MOST`` of it and no other container that is marked as the article holds ``RIVAL``.

Defined results: null, empty or markup-free-of-text html gives "" ; broken markup (unclosed tags, cut
references, stray "<") is read as browsers do, so far as it matters for text; of containers of equal points the
first in page order is the best; repeated rows give repeated results; other columns pass through, and an
existing output column is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
DROPPED = frozenset("head nav header footer aside form button input fieldset dialog menu".split()) | RAW
SCORED = frozenset("p pre td blockquote li dd h2 h3 h4".split())
# Words of class, id and role attributes that mark what is not the article, or is, or are comments.
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|reply|replies|respond|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|sidebar|side|widget|menu|nav\w*|breadcrumbs?|pagination|pager|toolbar|footer|header|masthead|copyright|login|signup|search|skip|hidden|complementary|contentinfo|tags)(?:$|[\s_-])",
    re.I,
)
IS_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|entry|post|story|body|text|hentry)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|reply|replies|respond|hidden)(?:$|[\s_-])", re.I)
SOME, MOST, RIVAL = 0.25, 0.5, 0.1

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
MARKS = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACE = re.compile(r"\s+")
COMMA = re.compile(r"[,،、，]")

LEAST_POINTS = 25  # a paragraph of fewer characters earns none


class Node:
    __slots__ = ("kids", "links", "marks", "old", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, marks: str = "") -> None:
        self.tag, self.parent, self.marks = tag, parent, marks
        self.kids: list[Node | str] = []
        #: ``old``: points that have come over more than one level
        self.points, self.old, self.size, self.links = 0.0, 0.0, 0, 0


def _marks(attrs: str) -> str:
    """Class, id and role in one string; " hidden" is added for what is not shown."""
    if not attrs or attrs.isspace():
        return ""
    found = []
    for name, value in MARKS.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            found.append("hidden" if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else "")
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            found.append("hidden")
        elif name != "aria-hidden":
            found.append(value)
    return " ".join(filter(None, found))


def parse(html: str) -> Node:
    """The tree of elements; implied end tags are supplied."""
    top = node = Node("", None)
    at, n, opened = 0, len(html), Counter()

    def leave(until: Node) -> Node:
        """The parent of ``until``, which is closed with all that is open inside."""
        inner = node
        while inner is not until:
            opened[inner.tag] -= 1
            inner = inner.parent
        opened[until.tag] -= 1
        return until.parent

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            node.kids.append(html[at:])
            break
        if m.start() > at:
            node.kids.append(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up)
            elif tag == "p":  # an end without a start stands for an empty paragraph
                node.kids.append(Node("p", node))
            continue
        if tag in SAME_LEVEL or tag in CLOSES_P:
            ends = SAME_LEVEL.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            stop, up = BOUNDARY.get(tag, set()), node
            while any(opened[t] > 0 for t in ends) and up.parent is not None and up.tag not in stop and up.tag not in ends and (up.tag in INLINE or tag not in CLOSES_P):
                up = up.parent
            if up.parent is not None and up.tag in ends:
                node = leave(up)
        attrs = m["attrs"] or m["attrs2"] or ""
        new = Node(tag, node, _marks(attrs))
        node.kids.append(new)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = closing.end() if closing else n
            continue
        node = new
        opened[tag] += 1
    return top


def _sized(top: Node) -> list[Node]:
    """Text size and link size of every node; elements that are never the article are cut off.  Returns nodes in page order."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        node.size = node.links = 0
        node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in DROPPED]
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    for node in reversed(order):
        for k in node.kids:
            if isinstance(k, str):
                node.size += len(k.strip())
            else:
                node.size += k.size
                node.links += k.size if k.tag == "a" else k.links
    return order


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or any(IS_ARTICLE.search(x) and not NOT_ARTICLE.search(x) for x in node.marks.split())


def _without_marked(top: Node) -> list[Node]:
    """Leaves out the containers whose marks outweigh what they hold; sizes anew, nodes in page order."""
    order = _sized(top)
    free = lambda node: node.size - node.links
    total = max(1, free(top))
    places = {id(node): i for i, node in enumerate(order)}
    last = list(range(len(order)))  # the place of each node's last descendant
    for i in range(len(order) - 1, 0, -1):
        up = places[id(order[i].parent)]
        last[up] = max(last[up], last[i])
    marked = lambda node: node.marks and node.tag not in ("article", "main", "body", "html") and NOT_ARTICLE.search(node.marks)
    rival = [int(_is_article(node) and not marked(node) and free(node) >= RIVAL * total) for node in order]
    before = [0, *itertools.accumulate(rival)]  # rivals in front of a place
    above = [0] * len(order)  # rivals that a node lies in
    for i in range(1, len(order)):
        up = places[id(order[i].parent)]
        above[i] = above[up] + rival[up]
    cut = set()
    for i, node in enumerate(order):
        if not marked(node):
            continue
        share = free(node) / total
        if share >= SOME and _is_article(node) and not COMMENTS.search(node.marks):
            continue
        outside = before[-1] - (before[last[i] + 1] - before[i]) - above[i] > 0 if share > MOST else True
        if outside:
            cut.add(id(node))
    if cut:
        for node in order:
            node.kids = [k for k in node.kids if isinstance(k, str) or id(k) not in cut]
        order = _sized(top)
    return order


def _score(top: Node) -> list[Node]:
    """Points of every node; returns nodes in page order."""
    order = _without_marked(top)
    for node in order:
        if node.size < LEAST_POINTS:
            continue
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if node.tag not in SCORED and own < LEAST_POINTS:
            continue
        text = "".join(k for k in node.kids if isinstance(k, str))
        points = (1 + len(COMMA.findall(text)) + min(node.size / 100, 3)) * (1 - node.links / node.size)
        up = node.parent if node.tag in SCORED else node
        if up is not None:
            up.points += points
    for node in reversed(order):
        if node.parent is not None:
            node.parent.old += node.points / 2 + node.old / 3
        node.points += node.old
    for node in order:
        if node.tag in ("article", "main") or node.marks and IS_ARTICLE.search(node.marks):
            node.points += 25
        if node.size:
            node.points *= 1 - node.links / node.size
    return order


END = Node("", None)


def _blocks(roots: list[Node], article: Node | None = None) -> list[str]:
    """The text of each block under ``roots``, in page order.  Lists of links are menus, but for those of ``article``: its
    references and glossaries are part of it."""
    found: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            s = SPACE.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if s:
                found.append(s)

    stack: list[Node | str | None] = list(reversed(roots))
    inside = False
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif k is END:
            flush()
            inside = False
        elif isinstance(k, str):
            text.append(k)
        elif k is article:
            flush()
            inside = True
            stack.append(END)
            stack.extend(reversed(k.kids))
        elif k.tag == "br":
            text.append(" ")
        elif k.tag in INLINE:
            # an inline element left open around blocks has none of its own
            stack.extend(reversed(k.kids))
        elif k.tag in ("ul", "ol", "dl") and k.size and k.links / k.size > 0.5 and not inside:
            flush()
        else:
            flush()
            stack.append(None)
            stack.extend(reversed(k.kids))
    flush()
    return found


#: Elements beside the best container that may belong to the article.
HEADINGS, SECTIONS = ("h1", "h2", "h3"), ("p", "div", "section", "blockquote", "pre", "table", "figure")


def _has_prose(node: Node) -> bool:
    """Whether a sibling has a paragraph's text, few links and no marks."""
    return not node.marks and node.size >= LEAST_POINTS and node.links < 0.25 * node.size


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    order = _score(parse(html))
    best = max((n for n in order if n.tag not in INLINE and n.tag not in SCORED), key=lambda n: n.points, default=None)
    if best is None or best.points <= 0:
        return "\n".join(_blocks([next((n for n in order if n.tag in ("article", "main")), next((n for n in order if n.tag == "body"), order[0]))]))
    roots = [best]
    if best.parent is not None:
        least = 0.2 * best.points
        # beside the best: what has points, headings, and sections with prose of their own that nothing marks
        roots = [k for k in best.parent.kids if k is best or not isinstance(k, str) and (k.points >= least or k.tag in HEADINGS or k.tag in SECTIONS and _has_prose(k))]
    return "\n".join(_blocks(roots, best if _is_article(best) else None))


@F.pandas_udf(T.StringType())
def _extract(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None) if len(html) else html


def extract_main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main text of each page's html; one row in, one row out, nothing shuffled."""
    ship(df.sparkSession)
    return df.withColumn(text, _extract(F.col(html)))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
