"""Cross-references, hierarchy, keys and labels of hierarchical documents, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# How each language names external acts and annexes.
EXTERNAL = {
    "en": r"(?U)Directive\s+\d{4}/\d+/\w+|Regulation\s+\(EU\)\s+No\s+[\d/]+",
    "it": r"(?U)direttiva\s+\d{4}/\d+/\w+|regolamento\s+\(UE\)\s+n\.\s*[\d/]+",
    "pl": r"(?U)dyrektywa\s+\d{4}/\d+/\w+|rozporządzenie\s+\(UE\)\s+nr\s+[\d/]+",
}
ARTICLE_WORD = {"en": "Article", "it": "Articolo", "pl": "Artykuł"}
ANNEX_WORD = {"en": "Annex(?:es)?", "it": "Allegat[oi]", "pl": "Załącznik(?:ów|iem|i)?"}
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
#: A range of more articles than this is taken as its two ends.
LONGEST_RANGE = 5000
# The act that a run of articles belongs to, where it isn't this document.
_ELSEWHERE = r"(?!\s+(?:of|del|della|dello|dell')\s*(?:the\s+)?(?:Regulation|Directive|Decision|regolamento|direttiva|decisione))"


def article_refs(text: Column, language: str = "en") -> Column:
    """Numbers of this document's articles that a text names, in order; ``N to M`` alone in a run is a range."""
    # Possessive numbers, so that the guard sees the whole of the last one.
    run = rf"(?iU)\b{ARTICLE_WORD[language]}s?\s++\d++[a-z]*+(?:\s*+(?:,|and|or|to)\s*+\d++[a-z]*+)*+{_ELSEWHERE}"

    def numbers(found: Column) -> Column:
        all_ = F.regexp_extract_all(F.lower(found), F.lit(r"\d+[a-z]*"), F.lit(0))
        digit = lambda i: F.regexp_extract(F.get(all_, F.lit(i)), r"^(\d+)", 1).try_cast("long")
        is_range = found.rlike(r"(?i)\sto\s") & (F.size(all_) == 2) & (digit(1) - digit(0)).between(0, LONGEST_RANGE)
        return F.when(is_range, F.sequence(digit(0), F.greatest(digit(0), digit(1))).cast("array<string>")).otherwise(all_)

    every = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), numbers)))
    keyed = F.transform(every, lambda a: F.struct(F.regexp_extract(a, r"^(\d+)", 1).try_cast("long").alias("n"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda x: x["a"])


# A run of articles in a line, and what follows one of another act.
_BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
RUN = rf"(?i)\b(?:Articles?|Articol[oi]){_BLANK}+\d\w*(?:{_BLANK}*(?:,|and|e|or|o){_BLANK}+\d\w*)*"
OTHER_ACT = rf"(?i)^{_BLANK}*(?:(?:to{_BLANK}+\d\w*{_BLANK}+)?of|del(?:la|lo|l')?){_BLANK}+(?:Regulation|Directive|Decision|Delegated|Implementing|Regolamento|Direttiva|Decisione)"


def reference_runs(text: Column) -> Column:
    """(kind, value, start) of a text's runs: ``article`` for each number of this document's articles, ``text`` for all between.

    The values joined are the text; ``start`` counts characters from 0. A run of
    articles that another act follows is text as a whole. A null text has no runs.
    """
    piece = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    number = r"\d\w*"

    def numbers(run: Column) -> Column:
        found, between = F.regexp_extract_all(run, F.lit(number), F.lit(0)), F.split(run, number, -1)
        return F.flatten(F.zip_with(between, found, lambda b, n: F.when(n.isNull(), F.array(piece("text", b))).otherwise(F.array(piece("text", b), piece("article", n)))))

    def whole(t: Column) -> Column:
        runs, between = F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), F.split(t, RUN, -1)
        after = F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0)))
        told = F.zip_with(runs, after, lambda r, a: F.when(a.rlike(OTHER_ACT), F.array(piece("text", r))).otherwise(numbers(r)))
        every = F.filter(F.flatten(F.zip_with(between, told, lambda b, r: F.concat(F.array(piece("text", b)), F.coalesce(r, F.array().cast("array<struct<kind:string,value:string>>"))))), lambda x: x["value"] != "")
        # Each run's start is the sum of lengths before it.
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,value:string,start:int>>").alias("out"))
        return F.aggregate(every, begin, lambda s, x: F.struct((s["at"] + F.length(x["value"])).alias("at"), F.concat(s["out"], F.array(F.struct(x["kind"].alias("kind"), x["value"].alias("value"), s["at"].alias("start")))).alias("out")))["out"]

    return let(text, whole)


# What follows an article's number where it is another act's.
_ITS_ACT = (
    r"(?i)^\s+(?:to\s+\d\w*\s+)?(?:of|del(?:la|lo|l')?)\s+(?:Regulation|Directive|Decision|Delegated|Implementing|Regolamento|Direttiva|Decisione|Rozporządzenie|Dyrektywa|Decyzja)"
)


def single_refs(text: Column, language: str = "en") -> Column:
    """The number right after each word for an article, unless another act follows it: no runs and no ranges, in order of numbers."""
    one = rf"(?i){ARTICLE_WORD[language]}s?\s+\d+[a-z]?"
    found, between = F.regexp_extract_all(text, F.lit(one), F.lit(0)), F.split(text, one, -1)
    after = F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0)))
    own = F.filter(F.zip_with(found, after, lambda m, a: F.when(~a.rlike(_ITS_ACT), F.regexp_extract(m, r"(\d+[a-zA-Z]?)$", 1))), lambda x: x.isNotNull())
    keyed = F.transform(F.array_distinct(own), lambda a: F.struct(F.regexp_extract(a, r"^(\d+)", 1).try_cast("long").alias("n"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda x: x["a"])


def external_refs(text: Column, language: str = "en") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(EXTERNAL[language]), F.lit(0))))


def annex_refs(text: Column, language: str = "en") -> Column:
    """Annexes I to IV that a text names."""
    lists = F.regexp_extract_all(text, F.lit(rf"(?U)\b{ANNEX_WORD[language]}\s+((?:I{{1,3}}|IV)\b(?:\s*(?:,|and|or|e|i)\s*(?:I{{1,3}}|IV)\b)*)"), F.lit(1))
    found = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(r"\b(?:I{1,3}|IV)\b"), F.lit(0))))
    return F.filter(F.array(*map(F.lit, ROMAN[:4])), lambda r: F.array_contains(found, r))


def structural_refs(text: Column, keyword: str, roman: bool) -> Column:
    """Parts, titles, chapters or sections that a text names, in order; ``X to Y`` is a range."""
    values = {r: i + 1 for i, r in enumerate(ROMAN)} | {w.upper(): n for w, n in NUMBER_WORDS.items()} | {str(i): i for i in range(1, 100)}
    book = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    one = r"(?:X?I{1,3}|IV|VI{0,3}|IX|XI{0,2}|\d{1,2}|" + "|".join(NUMBER_WORDS) + r")\b"
    runs = F.regexp_extract_all(text, F.lit(rf"(?i)\b{keyword}s?\s+({one}(?:\s*(?:,|and|or|to)\s*{one})*)"), F.lit(1))

    def numbers(run: Column) -> Column:
        found = F.transform(F.regexp_extract_all(F.upper(run), F.lit(one.upper().replace(r"\D", r"\d").replace(r"\B", r"\b")), F.lit(0)), lambda t: F.try_element_at(book, t))
        a, b = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        is_range = run.rlike(r"(?i)\sto\s") & (F.size(found) == 2) & (b >= a)
        return F.when(is_range, F.sequence(a, F.greatest(a, b))).otherwise(found)

    every = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(runs, numbers)), lambda n: n.isNotNull())))
    names = F.array(*map(F.lit, ROMAN))
    return F.transform(every, lambda n: F.coalesce(F.get(names, n - 1), n.cast("string")) if roman else n.cast("string"))


def hierarchy(parent_id: Column) -> dict[str, Column]:
    """Part, title, chapter, section and subsection of ``prt_III.tis_I.cpt_1.sct_1``."""
    pick = lambda tag: F.nullif(F.regexp_extract(parent_id, rf"(?:^|\.){tag}_([^.]+)", 1), F.lit(""))
    return {"part": pick("prt"), "title": pick("tis"), "chapter": pick("cpt"), "section": pick("sct"), "subsection": pick("sbs")}


def breadcrumb(part: Column, title: Column, chapter: Column, section: Column, article: Column, article_title: Column) -> Column:
    level = lambda name, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(f"{name} "), c))
    last = F.when(F.nullif(article, F.lit("")).isNotNull(), F.concat_ws(" — ", level("Article", article), F.nullif(article_title, F.lit(""))))
    return F.concat_ws(" > ", level("Part", part), level("Title", title), level("Chapter", chapter), level("Section", section), last)


def embedding_text(prefix: Column, text: Column, paragraph: Column | None = None) -> Column:
    head = prefix if paragraph is None else F.concat(prefix, F.lit("\nParagraph "), paragraph)
    return F.concat(head, F.lit("\n\n"), text)


def sub_article_of(article: Column) -> Column:
    return F.nullif(F.regexp_extract(article, r"(?i)^(\d+)[a-z]+$", 1), F.lit(""))


def citation(part: Column, title: Column, chapter: Column, section: Column, article: Column, annex: Column, node_id: Column) -> Column:
    level = lambda name, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(f"{name} "), c))
    path = F.concat_ws(", ", level("Part", part), level("Title", title), level("Chapter", chapter), level("Section", section), level("Article", article))
    return F.coalesce(level("Annex", annex), F.nullif(path, F.lit("")), node_id)


def uuid5(name: Column, namespace: str) -> Column:
    """The name-based UUID of version 5, so that writing a row again gives the same key."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
