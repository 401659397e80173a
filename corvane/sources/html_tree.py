"""A lenient tree of an HTML page, on the standard library's tokenizer.

That tokenizer takes several searches and calls for each tag. Pages of plain tags,
texts and comments alone are cut by one expression instead, and give the same tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

# Fixed values of the HTML standard: elements without content, and those before which an open <p> ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# A plain page's parts: end tag, tag with attributes and closing slash, text, comment. Elements whose content is no markup are not plain.
_ATTRIBUTE = r"""[ \t\n]+([a-z][a-z0-9_:-]*)(?:="([^"<>&]*)"|='([^'<>&]*)')?(?=[ \t\n/>]|\Z)"""
_PLAIN = re.compile(
    r"(</([a-z][a-z0-9]*)>"
    r"|<(?!(?:script|style|title|textarea|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math)[ \t\n/>])([a-z][a-z0-9]*)((?:" + _ATTRIBUTE.replace("([", "(?:[") + r")*)[ \t\n]*(/?)>"
    r"|([^<]+)"
    r"|<!--[^<>-]*(?:-[^<>-]+)*-->)"
)
_ATTRIBUTES = re.compile(_ATTRIBUTE)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    @property
    def id(self) -> str:
        return self.attrs.get("id", "")

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; a stack, as pages may nest deeply."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def find(self, tag: str, css: str = "") -> Node | None:
        return next((n for n in self.walk() if n.tag == tag and (not css or css in n.classes)), None)

    def text(self, joint: str = " ") -> str:
        out, stack = [], list(self.children[::-1])
        while stack:
            c = stack.pop()
            if isinstance(c, Node):
                stack += c.children[::-1]
            elif c.strip():
                out.append(c.strip())
        return joint.join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:  # an end without a start is passed over
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


@lru_cache(maxsize=4096)
def _attributes(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((name, a or b) for name, a, b in _ATTRIBUTES.findall(text))


def _built(builder: _Builder, html: str) -> bool:
    """Build a plain page's tree; False, with nothing built, for any other page."""
    parts = _PLAIN.findall(html)
    if sum(len(p[0]) for p in parts) != len(html):
        return False
    for _, end, tag, attributes, closed, text in parts:
        if text:
            builder.handle_data(unescape(text) if "&" in text else text)
        elif tag:
            (builder.handle_startendtag if closed else builder.handle_starttag)(tag, _attributes(attributes) if attributes else ())
        elif end:
            builder.handle_endtag(end)
    return True


def parse(html: str) -> Node:
    builder = _Builder()
    if not _built(builder, html or ""):
        builder.feed(html or "")
        builder.close()
    return builder.root
