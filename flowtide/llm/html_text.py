"""HTML extraction by composite text density (op10).

Each page becomes a tree of elements in one pass over its tags. Navigation, adverts, forms and the
like are cut off by element, role or name, unless what they hold shows that they are a wrapper around the
article. For each element that is left the composite density is its
characters per tag, corrected by how much of it is links. The element whose children's densities have
the largest sum is the centre of the article; the least density on its path from the body is the
threshold by which its surroundings are taken in.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import scan, spare, texts

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|xmp|noframes)\b[^>]*+>(?:.*?</(?P=raw)\b[^>]*+>|.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<odd>[^>]*+)>)"
    r"|</?[a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# The elements, roles and names by which pages mark what is not the article.
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
DROPPED_ELEMENTS = set(
    "nav footer aside form head button select option input label fieldset svg canvas object audio video menu dialog datalist".split()
)
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification popup modal overlay sidebar menu nav navbar navigation navigate breadcrumb "
    "breadcrumbs footer foot comment comments commentlist reply replies respond disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login search pagination pager widget toolbar alert".split()
)
HEADER_NAMES = set("header masthead topbar".split())
# These never hold the article, however much text they have.
NEVER_NAMES = set("comment comments commentlist reply replies respond disqus cookie cookies consent gdpr".split())
# A name with one of these tells what an element has or lacks, not what it is: has-sidebar, ad-free.
QUALIFIERS = set("has with without no free".split())
# Elements of running text.
TEXT_ELEMENTS = set("h1 h2 h3 h4 h5 h6 p ul ol dl blockquote pre table figure figcaption address hr".split())
# A start tag of the key closes an open element of the value, unless one of _FENCE stands in between.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


class Node:
    __slots__ = ("tag", "parent", "mark", "dropped", "chars", "tags", "link_chars", "link_tags", "children", "first", "last")

    def __init__(self, tag: str, parent: Node | None, mark: int, first: int):
        self.tag, self.parent, self.mark, self.first, self.last = tag, parent, mark, first, first
        self.dropped = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.children: list[Node] = []


CUT, DOUBTFUL = 1, 2


def _mark(tag: str, attrs: str, inside: bool) -> int:
    """Whether an element is not part of an article (CUT), or only if it isn't wrapped around one (DOUBTFUL); else 0.

    ``inside``: it stands in an article already.
    """
    if tag == "form":
        return DOUBTFUL
    if tag in DROPPED_ELEMENTS or tag == "header" and not inside:
        return CUT
    found = 0
    if "=" not in attrs:
        return found
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in DROPPED_ROLES:
            found = found or DOUBTFUL
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            for word in value.split():
                names = {x.lower() for x in _NAME.findall(word)}
                if names & QUALIFIERS:
                    continue
                if names & NEVER_NAMES:
                    return CUT
                if names & DROPPED_NAMES or not inside and names & HEADER_NAMES:
                    found = DOUBTFUL
    return found


def parse(page: str) -> tuple[Node, list[tuple[Node, int, str]]]:
    """The tree of a page and its text in order: (element, number of the block, raw text)."""
    root = Node("html", None, 0, 0)
    node, inside, block, at = root, 0, 0, 0
    pieces: list[tuple[Node, int, str]] = []
    opened: Counter[str] = Counter()

    def close(upto: Node) -> None:
        nonlocal node, inside
        while True:
            node.last = len(pieces)
            opened[node.tag] -= 1
            inside -= node.tag in ("article", "main")
            done, node = node is upto, node.parent or root
            if done:
                return

    def find(tags: set[str], fence: set[str]) -> Node | None:
        if not any(opened[t] > 0 for t in tags):
            return None
        x = node
        while x is not root and x.tag not in fence:
            if x.tag in tags:
                return x
            x = x.parent
        return None

    for m in _TAG.finditer(page):
        if m.start() > at:
            pieces.append((node, block, page[at : m.start()]))
        at = m.end()
        tag = m["name"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        elif tag == "br":
            pieces.append((node, block, " "))
        if m["end"]:
            upto = find({tag}, set())
            if upto is not None:
                close(upto)
            continue
        if tag in _CLOSES:
            old = find(_CLOSES[tag], _FENCE[tag])
            if old is not None:
                close(old)
        elif tag not in INLINE and tag not in VOID:
            old = find({"p"}, {"article", "main", "section", "div", "table", "td", "li", "blockquote", "button"})
            if old is not None:
                close(old)
        attrs = m["attrs"] if m["odd"] is None else m["odd"]
        new = Node(tag, node, _mark(tag, attrs, inside > 0), len(pieces))
        node.children.append(new)
        if tag not in VOID:
            node = new
            opened[tag] += 1
            inside += tag in ("article", "main")
    if at < len(page):
        pieces.append((node, block, page[at:]))
    close(root)
    return root, pieces


def _cut(nodes: list[Node], pieces: list[tuple[Node, int, str]]) -> None:
    """Decide which elements go: the marked ones with all they hold.

    If no article or main with text is free of marks, a doubtful element stays that holds one, or the greater part of the
    page's text outside links.
    """
    own = {id(n): 0 for n in nodes}
    for node, _, raw in pieces:
        own[id(node)] += len("".join(raw.split()))
    text, holds = dict(own), set()
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            up = id(node.parent)
            text[up] += 0 if node.tag == "a" else text[id(node)]
            if id(node) in holds or node.tag in ("article", "main") and text[id(node)]:
                holds.add(up)
    marked: set[int] = set()
    free = False
    for node in nodes:
        if node.mark or node.parent is not None and id(node.parent) in marked:
            marked.add(id(node))
        elif node.tag in ("article", "main") and text[id(node)]:
            free = True
    for node in nodes:
        doubt = node.mark == DOUBTFUL and not free and (id(node) in holds or 2 * text[id(node)] > text[id(nodes[0])])
        node.dropped = node.parent is not None and node.parent.dropped or bool(node.mark) and not doubt


def _count(nodes: list[Node], pieces: list[tuple[Node, int, str]]) -> None:
    """Characters, tags, characters of links and links in each element that is kept."""
    for node, _, raw in pieces:
        if not node.dropped:
            size = len(" ".join(raw.split()))
            node.chars += size
    for node in reversed(nodes):  # children come after their parents
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        parent = node.parent
        if parent is not None and not node.dropped:
            parent.chars += node.chars
            parent.tags += node.tags + 1
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags


def density(node: Node, body: Node) -> float:
    """Composite text density: characters per tag, weighed by the share of links against the page's."""
    if not node.chars:
        return 0.0
    chars, tags, links, anchors = node.chars, node.tags or 1, node.link_chars, node.link_tags
    base = math.log(chars / max(chars - links, 1) * links + body.link_chars / max(body.chars, 1) * chars + math.e)
    # An element of links only falls below one here and gets a density below zero.
    return chars / tags * math.log(max(chars / max(links, 1) * tags / max(anchors, 1), 1e-9)) / base


def article(page: str) -> str:
    """The article of one page: its blocks, one a line."""
    root, pieces = parse(page)
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(reversed(node.children))
    _cut(nodes, pieces)
    _count(nodes, pieces)
    kept = [n for n in nodes if not n.dropped]
    body = next((n for n in kept if n.tag == "body"), root)
    dense = {id(n): density(n, body) for n in kept}
    sums = {id(n): sum(dense[id(c)] for c in n.children if not c.dropped) for n in kept}
    best = max(kept, key=lambda n: (sums[id(n)], dense[id(n)]))
    first, last = _around(best, body, kept, dense, sums)
    blocks: dict[int, list[str]] = {}
    for node, block, raw in pieces[first:last]:
        if not node.dropped:
            blocks.setdefault(block, []).append(raw)
    lines = (" ".join(html.unescape("".join(raws)).split()) for raws in blocks.values())
    return "\n".join(line for line in lines if line)


def _around(best: Node, body: Node, kept: list[Node], dense: dict[int, float], sums: dict[int, float]) -> tuple[int, int]:
    """The pieces (from, to) of the article whose centre is ``best``.

    Marked articles come first: the outermost one around the centre, or the one of the largest sum
    inside it. Otherwise the path to the body is climbed: neighbours of the element reached so far belong to the article
    if they are as dense as the least dense element of the path, or running text that is not mostly links. An ancestor is
    climbed to once all its children belong.
    """
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for tag in ("article", "main"):
        marked = [n for n in path if n.tag == tag]
        if marked:
            return marked[-1].first, marked[-1].last
        below = [n for n in kept if n.tag == tag and n.chars and best.first <= n.first and n.last <= best.last]
        if below:
            one = max(below, key=lambda n: (sums[id(n)] + dense[id(n)], n.chars))
            return one.first, one.last
    on_path = path[: path.index(body) + 1] if body in path else path
    threshold = min(dense[id(n)] for n in on_path)

    def belongs(n: Node) -> bool:
        text = n.tag in TEXT_ELEMENTS and 2 * n.link_chars <= n.chars
        return n.dropped or not n.chars or text or dense[id(n)] >= threshold and 2 * n.link_chars <= n.chars

    first, last = best.first, best.last
    for child, node in zip(on_path, on_path[1:]):
        at = node.children.index(child)
        low = high = at
        while low > 0 and belongs(node.children[low - 1]):
            low -= 1
        while high < len(node.children) - 1 and belongs(node.children[high + 1]):
            high += 1
        if low == 0 and high == len(node.children) - 1:
            first, last = node.first, node.last
        else:
            first, last = min(first, node.children[low].first), max(last, node.children[high].last)
            break
    return first, last


def extract(pages: DataFrame, source: str = "html", out: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` of pages (all by default) and the article as ``out``, which replaces a column of that name.

    Null and empty pages, and pages without text, give an empty text. Each row is read whole and by
    itself, so repeated rows and ties give equal texts; a page cut off in the middle counts as closed there.
    """
    kept = [c for c in (keep if keep is not None else pages.columns) if c != out]
    own = spare(pages, "_source")
    rows = pages.select(*kept, F.col(source).alias(own))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*kept).schema)

    def build():
        def step(batch):
            yield {c: batch.column(c) for c in kept} | {out: [article(t) for t in texts(batch, own)]}

        return step

    return scan(rows, build, f"{fields}`{out}` string")
