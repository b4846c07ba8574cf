"""Small per-page HTML helper run inside ``mapInPandas``.

A stdlib ``html.parser`` tree (the same tokenizer family the reference's
"html.parser" choice uses; no third-party parser is needed): end tags close
the most recent open element of that name, unmatched end tags are ignored,
void elements never open, character references are decoded. ``text`` of an
element is every descendant text node stripped, empties dropped, joined with
one blank (script/style/comments excluded).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link",
        "meta", "param", "source", "track", "wbr"}
SKIP_TEXT = {"script", "style", "template"}
BOX_CLASS = re.compile(r"\breview-element\b")
TAG_NAMES = {"span", "a", "div"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children = []

    @property
    def classes(self):
        return (self.attrs.get("class") or "").split()

    def walk(self, skip=()):
        """Descendants (elements and texts) in document order, without those
        below elements named in ``skip``. An explicit stack: unclosed tags
        nest as deep as the page is long."""
        stack = [iter(self.children)]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
                continue
            yield c
            if isinstance(c, Node) and c.children and c.tag not in skip:
                stack.append(iter(c.children))

    def iter(self):
        """Descendant elements in document order (self excluded)."""
        return (c for c in self.walk() if isinstance(c, Node))

    def text(self) -> str:
        parts = (c.strip() for c in self.walk(SKIP_TEXT) if not isinstance(c, Node))
        return " ".join(s for s in parts if s)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(n)
        if tag not in VOID:
            self.cur = n

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(
            Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def is_box(n: Node) -> bool:
    if n.tag != "div":
        return False
    cls = n.attrs.get("class")
    if cls is None:
        return False
    return any(BOX_CLASS.search(c) for c in [*cls.split(), cls])


def review_boxes(html: str, head_chars: int = 260):
    """[(pos, tags, head, body)] for every review box, nested ones included."""
    out = []
    for pos, box in enumerate(n for n in parse(html).iter() if is_box(n)):
        tags, body = [], None
        for d in box.iter():
            if d.tag in TAG_NAMES and "tag" in d.classes:
                tags.append(d.text())
            if body is None and d.tag == "div" and "text" in d.classes:
                body = d.text()
        out.append((pos, tags, box.text()[:head_chars], body))
    return out


def anchors(html: str, needle: str = "/anime/", ranking_class: str = "anime_ranking_h3"):
    """[(pos, href, in_ranking)] of ``a[href*=needle]`` in document order;
    ``in_ranking`` marks anchors inside ``h3.<ranking_class>``."""
    out = []
    pos = 0
    for n in parse(html).iter():
        if n.tag == "a" and needle in n.attrs.get("href", "") and "href" in n.attrs:
            p, inside = n.parent, False
            while p is not None:
                if p.tag == "h3" and ranking_class in p.classes:
                    inside = True
                    break
                p = p.parent
            out.append((pos, n.attrs["href"], inside))
            pos += 1
    return out


def outline(html: str, container: str = "article", item: str = "p") -> tuple[int, list[str]]:
    """The number of ``item`` elements inside ``container`` elements, and the
    targets of all links, in document order."""
    n, links, stack = 0, [], [(parse(html), False)]
    while stack:
        node, inside = stack.pop()
        n += inside and node.tag == item
        if node.tag == "a" and "href" in node.attrs:
            links.append(node.attrs["href"])
        inside = inside or node.tag == container
        stack.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))
    return n, links
