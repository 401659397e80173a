"""Formulas in LaTeX, reference lists in text, and lines of provisions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of a formula, displayed ones first.
FORMULA = r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|(?<!\$)\$(?!\$).+?(?<!\$)\$(?!\$)"


def formulas(markdown: Column) -> Column:
    """All formulas with their delimiters, in order; one inside another isn't taken apart."""
    return F.regexp_extract_all(markdown, F.lit(FORMULA), F.lit(0))


def with_formulas(text: Column, found: Column) -> Column:
    """The text with the i-th formula in the place of the first ``[FORMULA_i]``; marks without a formula stay."""

    def put(acc: Column, i: Column) -> Column:
        mark = F.concat(F.lit("[FORMULA_"), i.cast("string"), F.lit("]"))
        at = F.position(mark, acc)
        rest = F.substring(acc, at + F.char_length(mark), F.char_length(acc))
        return F.when(at > 0, F.concat(F.substring(acc, F.lit(1), at - 1), F.get(found, i), rest)).otherwise(acc)

    indices = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indices, text, put)


def listed(csv: Column) -> Column:
    """The trimmed members of a comma-separated list; empty ones are left out, and a null has none."""
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def lists(csv: Column, member: Column) -> Column:
    """Whether the list has this very member: 92 isn't in 192."""
    return F.array_contains(listed(csv), member)


# An item that goes on in a line, and how lines of a provision begin.
INLINE_ITEM = r"(?i)(?:;\s*|:\s+)(\([a-z]{1,4}\)\s)"
ROMAN_ITEM = r"(?i)^\((?:i{1,3}|iv|vi{0,3})\)\s"
LETTER_ITEM = r"(?i)^\([a-z]+\)\s"
PARAGRAPH = r"^\d+\.(?:\s|$)"


def provision_lines(text: Column) -> Column:
    """(kind, line) of a provision's lines that aren't blank, items within a line on lines of their own."""
    lines = F.transform(F.split(F.regexp_replace(text, INLINE_ITEM, ";\n$1"), "\n"), lambda s: F.trim(s))
    return F.transform(F.filter(lines, lambda s: s != ""), lambda s: F.struct(line_kind(s).alias("kind"), s.alias("line")))


def line_kind(line: Column) -> Column:
    """What a trimmed line is: an item with a small roman number or with letters, a numbered paragraph, or plain."""
    return F.when(line.rlike(ROMAN_ITEM), "roman").when(line.rlike(LETTER_ITEM), "letter").when(line.rlike(PARAGRAPH), "paragraph").otherwise("plain")
