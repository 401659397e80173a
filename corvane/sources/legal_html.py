"""Legal pages as rows: one for each article, its numbered paragraphs, and each annex.

The page's tree needs a parser, so this source is a ``mapInPandas`` over pages;
hierarchy, labels, references and keys are Column expressions on its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import refs
from .html_tree import Node, parse

# Tags and classes of the published pages, and the names' space of node keys.
NOISE_TAGS = {"script", "style", "nav", "footer"}
NOISE_CLASSES = {"helpPanel"}
TITLE_CLASSES = {"title-article-norm", "eli-title", "stitle-article-norm", "title-annex-1"}
INLINE = {"strong", "em", "a", "span", "sub", "sup"}
LEAST_CHARS, LEAST_WORDS = 5, 100
#: A mark of amendment, with the word after it.
AMENDED = re.compile(r"[▼◄►]\s*\w*")
NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
RAW = "page_id long, language string, pos int, level string, chunk_type string, article string, article_title string, annex_id string, annex_title string, para_id string, parent_id string, text string, has_table boolean, has_formula boolean"


def markdown(table: Node) -> str:
    """A table's rows, with the rule of a header after the first; rows without cells are left out."""
    out = []
    for i, row in enumerate(n for n in table.walk() if n.tag == "tr"):
        cells = [c.text().replace("|", "\\|") for c in row.walk() if c.tag in ("td", "th")]
        if cells:
            out.append("| " + " | ".join(cells) + " |")
            if i == 0:
                out.append("|" + " --- |" * len(cells))
    return "\n".join(out)


def _is_formula(node: Node) -> bool:
    return node.tag == "img" and node.attrs.get("src", "").startswith("data:image")


class Reader:
    """Lines of a part of a page; formulas are numbered as they come, or not at all."""

    def __init__(self, numbered: bool = True):
        self.numbered, self.formulas, self.done = numbered, 0, set()

    def formula(self) -> str:
        self.formulas += 1
        return f"[FORMULA_{self.formulas - 1}]" if self.numbered else "[FORMULA]"

    def below(self, node: Node) -> Iterator[str]:
        for child in node.elements():
            yield from self.lines(child)

    def lines(self, node: Node) -> Iterator[str]:
        css = node.classes
        if id(node) in self.done or node.tag in NOISE_TAGS or css & (TITLE_CLASSES | NOISE_CLASSES) or (node.tag == "p" and "modref" in css):
            return
        if _is_formula(node):
            yield self.formula()
        elif node.tag == "table":
            if "borderOj" in css:
                yield "[TABLE]"
            if table := markdown(node):
                yield table
        elif node.tag == "p":
            yield from self.paragraph(node)
        elif node.tag == "div" and {"grid-container", "grid-list"} <= css:
            yield from self.points(node)
        elif node.tag == "div" and "norm" in css:
            if number := node.find("span", "no-parag"):
                yield from self.numbered_paragraph(node, number.text(""))
            elif node.elements():
                yield from self.below(node)
            elif len(text := node.text()) >= LEAST_CHARS:
                yield text
        else:
            yield from self.below(node)

    def own_words(self, node: Node, tags: set[str]) -> list[str]:
        """The node's text and that of its children of these kinds; divisions are read apart."""
        words = [c.strip() if isinstance(c, str) else c.text() if c.tag in tags and "no-parag" not in c.classes else "" for c in node.children]
        return [w for w in words if w]

    def paragraph(self, node: Node) -> Iterator[str]:
        words = []
        for c in node.children:
            if isinstance(c, str):
                words.append(c.strip())
            elif _is_formula(c):
                words.append(self.formula())
            elif c.tag in INLINE:
                words.append(c.text())
        if len(text := " ".join(w for w in words if w)) >= LEAST_CHARS:
            yield text

    def numbered_paragraph(self, node: Node, number: str) -> Iterator[str]:
        inner = [c for c in node.elements() if c.tag == "div"]
        lead = self.own_words(node, {"p", "span", "a", "em", "strong"})
        if not lead and inner and "inline-element" in inner[0].classes:
            # The sentence is in a wrapper: all of it, or its first direct paragraph.
            source = next((c for c in inner[0].elements() if c.tag == "p"), None) if inner[0].elements() else inner[0]
            if source is not None and (text := source.text()):
                lead = [text]
                self.done.add(id(source))
        yield " ".join([number, *lead])
        for c in inner:
            yield from self.lines(c)

    def points(self, node: Node) -> Iterator[str]:
        kids = [c for c in node.elements() if c.tag == "div"]
        rows = [c for c in kids if "grid-row" in c.classes]
        if rows:
            pairs = [(cols[0], cols[1]) for r in rows if len(cols := [c for c in r.elements() if c.tag == "div"]) >= 2]
            tags = {"p", "span", "em", "strong", "a"}
        else:
            column = lambda k: next((c for c in kids if f"grid-list-column-{k}" in c.classes), None)
            pairs, tags = [(column(1), column(2))], {"p"}
            if None in pairs[0]:
                if text := node.text():
                    yield text
                return
        for label, body in pairs:
            entry = " ".join([label.text(""), *self.own_words(body, tags)]).strip()
            if entry:
                yield f"  {entry}"
            for c in body.elements():
                if c.tag == "div":
                    yield from self.lines(c)


def _plain(lines: Iterator[str]) -> str:
    return AMENDED.sub("", "\n".join(lines)).strip()


def _article_title(article: Node) -> str:
    box = article.find("div", "eli-title")
    if box is None:
        return ""
    named = box.find("p", "stitle-article-norm")
    if named is not None:
        return named.text()
    return next((t for p in box.walk() if p.tag == "p" and "title-article-norm" not in p.classes and (t := p.text())), "")


def page_rows(html: str) -> Iterator[dict]:
    """Articles, each followed by its paragraphs if it has two and words enough, then annexes."""
    root = parse(html)
    named = [n for n in root.walk() if n.tag == "div" and "." not in n.id]
    for a in named:
        if not a.id.startswith("art_"):
            continue
        reader = Reader()
        text = _plain(reader.below(a))
        if not text:
            continue
        row = {"level": "ARTICLE", "chunk_type": "ARTICLE", "article": a.id[4:], "article_title": _article_title(a), "parent_id": a.parent.id if a.parent else ""}
        yield row | {"text": text, "has_table": a.find("table") is not None, "has_formula": reader.formulas > 0}
        paragraphs = [(d, s) for d in a.walk() if d.tag == "div" and "norm" in d.classes and (s := next((c for c in d.elements() if c.tag == "span" and "no-parag" in c.classes), None))]
        if len(paragraphs) >= 2 and len(text.split()) >= LEAST_WORDS:
            for d, s in paragraphs:
                if body := _plain(Reader(numbered=False).lines(d)):
                    yield row | {"level": "PARAGRAPH", "chunk_type": "PARAGRAPH", "para_id": s.text("").rstrip("."), "text": body, "has_table": d.find("table") is not None, "has_formula": any(map(_is_formula, d.walk()))}
    for x in named:
        if x.id.startswith("anx_") and (text := _plain(Reader().below(x))):
            title = x.find("p", "title-annex-2")
            yield {"level": "ANNEX", "chunk_type": "ARTICLE", "annex_id": x.id[4:], "annex_title": title.text() if title else "", "text": text, "has_table": x.find("table") is not None, "has_formula": False}


def raw_rows(pages: DataFrame) -> DataFrame:
    """RAW rows of (page_id, language, html)."""
    names = [c.split()[0] for c in RAW.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [{"page_id": p, "language": lang, "pos": i, **r} for p, lang, html in zip(pdf["page_id"], pdf["language"], pdf["html"], strict=True) for i, r in enumerate(page_rows(html or ""))]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return pages.select("page_id", "language", "html").mapInPandas(run, RAW)


def nodes(pages: DataFrame, language: str = "en") -> DataFrame:
    """Nodes with hierarchy, references, labels and keys; the first of each key in a page's order stays."""
    raw = raw_rows(pages.where(F.col("language") == language))
    human = F.when(F.col("level") == "ANNEX", F.format_string("anx_%s_%s", "annex_id", "language")).when(F.col("level") == "PARAGRAPH", F.format_string("art_%s_p%s_%s", "article", "para_id", "language")).otherwise(F.format_string("art_%s_%s", "article", "language"))
    keyed = raw.withColumn("node_id", human)
    w = Window.partitionBy("page_id", "node_id").orderBy("pos")
    once = keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumns(refs.hierarchy(F.col("parent_id")))
    # A paragraph's references are those of its article.
    of = Window.partitionBy("page_id", "article")
    whole = F.coalesce(F.max(F.when(F.col("level") == "ARTICLE", F.col("text"))).over(of), F.col("text"))
    linked = once.withColumn("_whole", whole).withColumns(
        {
            "referenced_articles": refs.article_refs(F.col("_whole"), language),
            "referenced_external": refs.external_refs(F.col("_whole"), language),
            "referenced_annexes": refs.annex_refs(F.col("_whole"), language),
            "referenced_parts": refs.structural_refs(F.col("_whole"), "Part", True),
            "referenced_titles": refs.structural_refs(F.col("_whole"), "Title", True),
            "referenced_chapters": refs.structural_refs(F.col("_whole"), "Chapter", False),
            "referenced_sections": refs.structural_refs(F.col("_whole"), "Section", False),
        }
    )
    prefix = refs.breadcrumb(*(F.col(c) for c in ("part", "title", "chapter", "section", "article", "article_title")))
    embed = F.when(F.col("level") == "PARAGRAPH", refs.embedding_text(prefix, F.col("text"), F.col("para_id"))).otherwise(refs.embedding_text(prefix, F.col("text")))
    return linked.drop("_whole").withColumns(
        {
            "key": refs.uuid5(F.col("node_id"), NAMESPACE),
            "sub_article_of": refs.sub_article_of(F.col("article")),
            "parent_article_id": F.when(F.col("level") == "PARAGRAPH", F.format_string("art_%s_%s", "article", "language")),
            "embedding_text": embed,
            "citation": refs.citation(*(F.col(c) for c in ("part", "title", "chapter", "section", "article", "annex_id", "node_id"))),
        }
    )


def strip_tags(html):
    """The text of a simple page by expressions alone: noise elements, then tags, then runs of blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
