"""Wrappers with telling names, pages without an article element, and densities against a plain recursion."""

import math
import random

import pytest
from flowtide.llm import html_text

ARTICLE = "<article><h1>Title</h1><p>" + "word " * 60 + "</p></article>"
TEXT = "Title\n" + ("word " * 60).strip()


@pytest.mark.parametrize("wrapper", [
    '<div class="layout has-sidebar">{a}<div class="sidebar"><p>{s}</p></div></div>', '<form id="aspnetForm">{a}<div class="promo">{s}</div></form>',
    '<div class="content-with-comments">{a}<div class="comments">{s}</div></div>', '<section class="ad-free">{a}</section><aside>{s}</aside>',
    '<div id="menu-page">{a}<form><p>{s}</p></form></div>',
])
def test_wrappers_keep_their_article(wrapper):
    page = "<html><body><nav><a href=x>home</a></nav>" + wrapper.format(a=ARTICLE, s="side " * 200) + "</body></html>"
    assert html_text.article(page) == TEXT


def test_a_wrapper_without_article():
    inner = "<h1>Title</h1><p>" + "word " * 60 + "</p>"
    assert html_text.article(f"<body><form action=x><div>{inner}</div><input></form><div class=sidebar>few words</div></body>") == TEXT
    # Comments go, however long they are, and so does a form beside an article.
    comments = "<div id='comments'><article class='comment'><p>" + "I say " * 300 + "</p></article></div>"
    assert html_text.article(f"<body><div>{inner}</div>{comments}</body>") == TEXT
    assert html_text.article(f"<body>{ARTICLE}<form><p>{'fill in ' * 300}</p></form></body>") == TEXT


def test_notices_headlines_and_edges():
    dense = "<div><p>" + "long text " * 40 + "</p><p>" + "more text " * 40 + "</p></div>"
    page = (
        "<body><div class=nav><a>x</a></div><div id=content><h1>Head</h1><p>Short.</p>" + dense + "<p>End.</p><p class='notice'>We use it</p></div>"
        "<div><a href=1>link one</a> <a href=2>link two</a></div></body>"
    )
    lines = html_text.article(page).split("\n")
    assert lines[:2] == ["Head", "Short."] and lines[-1] == "End." and len(lines) == 5


def made(rnd, depth):
    """(html, characters, tags, characters in links, links, children) of a random element."""
    if depth == 0 or rnd.random() < 0.3:
        words = "x" * rnd.randrange(1, 80)
        if rnd.random() < 0.3:
            return f"<a href=y>{words}</a>", len(words), 0, len(words), 1, []
        return f"<div>{words}</div>", len(words), 0, 0, 0, []
    below = [made(rnd, depth - 1) for _ in range(rnd.randrange(1, 4))]
    page = "<div>" + "".join(b[0] for b in below) + "</div>"
    return page, sum(b[1] for b in below), sum(b[2] + 1 for b in below), sum(b[3] for b in below), sum(b[4] for b in below), below


def plain_density(chars, tags, links, anchors, body):
    if not chars:
        return 0.0
    share = body[3] / max(body[1], 1)
    inside = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    return chars / (tags or 1) * math.log(max(chars / max(links, 1) * (tags or 1) / max(anchors, 1), 1e-9)) / inside


@pytest.mark.parametrize("seed", range(8))
def test_densities(seed):
    rnd = random.Random(seed)
    below = [made(rnd, 4) for _ in range(3)]
    page = "<body>" + "".join(b[0] for b in below) + "</body>"
    body = ("", sum(b[1] for b in below), sum(b[2] + 1 for b in below), sum(b[3] for b in below), sum(b[4] for b in below), below)
    root, pieces = html_text.parse(page)
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(reversed(node.children))
    html_text._cut(nodes, pieces)
    html_text._count(nodes, pieces)
    top = root.children[0]

    def compare(node, want):
        assert (node.chars, node.tags, node.link_chars, node.link_tags) == want[1:5]
        assert html_text.density(node, top) == pytest.approx(plain_density(*want[1:5], body), rel=1e-12)
        assert len(node.children) == len(want[5])
        for child, one in zip(node.children, want[5]):
            compare(child, one)

    compare(top, body)
