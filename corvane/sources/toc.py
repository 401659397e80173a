"""Tables of contents: pages of nested lists as rows, one for each article or annex, with the place it inherits.

An item of a list is either a heading, which its own lists inherit, or a link to an
article or annex. A page's tree needs a parser, so pages are mapped in batches; what
an item's label says is told by expressions of one place, below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_tree import Node, parse

# The block of a published page that holds the lists, and the blocks of an item's own label.
ROOTS = (("id", "block-isrb-tree"), ("class", "view-id-isrb_tree"))
LABELS = ("contextual-region", "isrb-tree-item")
# Labels of headings, from the widest to the narrowest, and of articles and annexes.
HEADINGS = {
    "part": re.compile(r"PART\s+([A-Z]+(?:\s+[A-Z])?)\s*[:\-]", re.I),
    "title": re.compile(r"TITLE\s+([IVX\d]+)\s*[:\-]", re.I),
    "chapter": re.compile(r"CHAPTER\s+(\d+)\s*[:\-]", re.I),
    "section": re.compile(r"Section\s+(\d+)\s*[:\-]"),
}
ARTICLE = re.compile(r"Article\s+(\d+)\s*([a-z]?)\s*[:\-]\s*(.+)", re.I)
ANNEX = re.compile(r"ANNEX\s+([IVX]+)\s*[:\-]\s*(.+)", re.I)
LEVELS = tuple(HEADINGS)
ROWS = "page_id long, pos int, article string, article_title string, part string, title string, chapter string, section string, is_annex boolean"


def _root(tree: Node) -> Node | None:
    for kind, name in ROOTS:
        for node in tree.walk():
            if node.tag == "div" and (node.id == name if kind == "id" else name in node.classes):
                return node
    return None


def _own(item: Node) -> Iterator[Node]:
    """An item's elements in order, without those of lists in it."""
    stack = item.elements()[::-1]
    while stack:
        node = stack.pop()
        if node.tag not in ("ul", "ol", "li"):
            yield node
            stack += node.elements()[::-1]


def _label(item: Node) -> tuple[str, bool]:
    """An item's label, and whether it is a link."""
    own = list(_own(item))
    block = next((n for css in LABELS for n in own if n.tag == "div" and css in n.classes), None)
    if block is None:
        return "", False
    link = block.find("a")
    return " ".join((link or block).text().split()), link is not None


def _below(place: dict[str, str], label: str) -> dict[str, str]:
    """The place that a heading's lists inherit: narrower levels begin anew."""
    for i, level in enumerate(LEVELS):
        found = HEADINGS[level].match(label)
        if found:
            name = found[1].upper() if level in ("part", "title") else found[1]
            return {x: place[x] for x in LEVELS[:i]} | {level: name} | dict.fromkeys(LEVELS[i + 1 :], "")
    return place


def _leaf(place: dict[str, str], label: str) -> dict | None:
    found = ARTICLE.match(label)
    if found:
        return {"article": found[1] + found[2], "article_title": found[3].strip(), **place, "is_annex": False}
    found = ANNEX.match(label)
    if found:
        return {"article": f"ANNEX_{found[1].upper()}", "article_title": found[2].strip(), **dict.fromkeys(LEVELS, ""), "is_annex": True}
    return None


def leaves(html: str | None) -> Iterator[dict]:
    """Articles and annexes of a page's first list, in document order; lists may nest to any depth."""
    root = _root(parse(html or ""))
    top = root.find("ul") if root else None
    if top is None:
        return
    stack = [(item, dict.fromkeys(LEVELS, "")) for item in reversed(top.elements()) if item.tag == "li"]
    while stack:
        item, place = stack.pop()
        label, link = _label(item)
        if link:
            leaf = _leaf(place, label)
            if leaf:
                yield leaf
        else:
            place = _below(place, label)
        inner = next((n for n in item.elements() if n.tag == "ul"), None)
        if inner is not None:
            stack += [(n, place) for n in reversed(inner.elements()) if n.tag == "li"]


def entries(pages: DataFrame) -> DataFrame:
    """The rows of (page_id, html) pages. A page without the block of lists has none, nor has a null one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            rows = [{"page_id": page, "pos": pos, **leaf} for page, html in zip(batch["page_id"], batch["html"], strict=True) for pos, leaf in enumerate(leaves(html))]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(run, ROWS)


def with_key_terms(rows: DataFrame, terms: DataFrame, of: Column | None = None) -> DataFrame:
    """Entries with the (article, key_terms) of articles that have some; annexes have none, nor have entries for which ``of`` doesn't hold."""
    takes = ~F.col("is_annex") if of is None else ~F.col("is_annex") & of
    found = rows.join(terms.select(F.col("article").alias("_article"), "key_terms"), (F.col("article") == F.col("_article")) & takes, "left")
    return found.drop("_article").withColumn("key_terms", F.coalesce("key_terms", F.lit("")))
