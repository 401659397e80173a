"""Query-text functions as Column expressions.

Dictionary substitution is one pass: the text is cut into matches and the
stretches between them, matches are looked up, and the parts are joined again,
so that an expansion is never searched itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of the domain, expanded case-sensitively.
ABBREVIATIONS = {
    "CET1": "Common Equity Tier 1",
    "AT1": "Additional Tier 1",
    "T2": "Tier 2 capital",
    "LCR": "Liquidity Coverage Ratio",
    "NSFR": "Net Stable Funding Ratio",
    "MREL": "Minimum Requirement for own funds and Eligible Liabilities",
    "RWA": "risk-weighted assets",
    "IRB": "Internal Ratings-Based approach",
    "CVA": "Credit Valuation Adjustment",
    "CCR": "Counterparty Credit Risk",
    "EAD": "Exposure at Default",
    "LGD": "Loss Given Default",
    "ECAI": "External Credit Assessment Institution",
    "SFT": "Securities Financing Transaction",
    "CCP": "Central Counterparty",
    "QCCP": "Qualifying Central Counterparty",
    "EBA": "European Banking Authority",
    "STS": "Simple Transparent and Standardised securitisation",
    "SEC-IRBA": "Securitisation Internal Ratings-Based Approach",
    "SEC-SA": "Securitisation Standardised Approach",
    "SA": "Standardised Approach",
    "CIU": "Collective Investment Undertaking",
    "NPE": "Non-Performing Exposure",
    "TREA": "Total Risk Exposure Amount",
    "HQLA": "High Quality Liquid Asset",
    "PD": "Probability of Default",
    "CF": "Conversion Factor",
    "SME": "Small and Medium-sized Enterprise",
    "IPRE": "Income-Producing Real Estate",
    "HVCRE": "High-Volatility Commercial Real Estate",
}
# Everyday terms and the domain's own, matched in any case.
SYNONYMS = {
    "preference shares": "Additional Tier 1 instruments",
    "perpetual bonds": "Additional Tier 1 instruments",
    "subordinated notes": "Tier 2 instruments",
    "subordinated debt": "Tier 2 instruments",
    "bail-in bonds": "eligible liabilities",
    "minority interests": "minority interest capital instruments",
    "non-performing loans": "Non-Performing Exposures",
    "non-performing loan": "Non-Performing Exposure",
    "securitisation position": "securitisation exposure",
    "enterprises": "corporates",
    "enterprise": "corporate",
    "local authority": "regional government or local authority",
    "local public authority": "regional government or local authority",
    "local authorities": "regional governments or local authorities",
    "pledged assets": "encumbered assets",
    "pledged collateral": "encumbered assets",
    "core capital": "Common Equity Tier 1",
    "accumulated earnings": "retained earnings",
    "maximum allowable exposure": "large exposure",
    "pledged as collateral": "encumbered",
    "easily sellable": "liquid assets high quality",
    "available liquid resources": "liquid assets",
    "solvency threshold": "initial capital own funds",
    "internal permission for tailored risk evaluation": "Internal Ratings-Based approach IRB",
    "blend of assets": "mixed pool",
    "external credit assessment is missing": "unrated",
    "no external credit assessment": "unrated",
}
# Title words that say nothing.
STOPWORDS = [
    "requirements", "requirement", "article", "articles", "institution", "institutions", "regulation", "regulations", "general", "specific", "provisions", "provision", "the",
    "of", "for", "and", "or", "in", "to", "a", "an", "on", "by", "with", "that", "this", "is", "are", "be", "been", "have", "has", "not", "which",
    "from", "at", "as", "its", "their", "it", "shall", "may", "must",
]
# Forms of greeting, of questions over several articles, and of references.
GREETING = r"(?iu)^\s*(?:hi|hello|hey|thanks|thank\s+you|ok|okay|test|bye|good\s+(?:morning|afternoon|evening))[!.,\s]*$"
MULTI_HOP = (
    r"(?iu)\b(?:relationship\s+between|difference\s+between|compare\s+(?:the\s+)?\w+|how\s+(?:does|do)\s+.{1,40}\s+(?:affect|interact|relate\s+to)|interaction\s+between|under\s+both"
    r"|in\s+conjunction\s+with|or\s+must\s+it|must\s+it\s+do|how\s+would\s+this\s+change|is\s+this\s+(?:always\s+)?the\s+same\s+as|if\s+(?:instead|rather|alternatively)"
    r"|does\s+this\s+(?:change|differ|vary)|do\s+the\s+(?:eligibility\s+)?criteria\s+differ)\b"
)
CITED = r"(?iU)\b(?:art(?:icle|\.)?)\s*(\d\w*)"
RANGE = r"(?iU)\bArticles?\s+(\d+[a-z]*)\s+to\s+(\d+[a-z]*)\b"
FOREIGN = r"(?iU)\bArticles?\s+\d\w*(?:\s*(?:,|and|or)\s*\d\w*)*\s+of\s+(?:Directive|Regulation)\b[^\n,;]*"
COORDINATED = r"(?iU)\bArticles?\s+\d\w*(?:\s*(?:,|and|or)\s*\d\w*)+"
REFERENCE = r"(?iU)\bArticle\s+(\d\w*)\b"
SUBORDINATE = (
    r"(?iU)\b(?:as\s+per|pursuant\s+to|deducted\s+(?:from|under)|excluded\s+(?:from|under)|calculated\s+(?:under|pursuant\s+to)|in\s+accordance\s+with)\s+Article\s+\d\w*(?:\s*\([^)]*\))*"
    r"|\bunder\s+Article\s+\d\w*\s*\([^)]+\)|\breferred\s+to\s+in\s+(?:point\s+\([^)]+\)\s+of\s+)?Article\s+\d\w*(?:\s*\([^)]*\))*"
)
# Forms of questions for a definition.
DEFINITION = (
    "(?iU)(?:(?:what\\s+(?:is|are)\\s+(?:(?:a|an|the)\\s+)?(?:definition\\s+of\\s+)?|what\\s+does\\s+|define\\s+|definition\\s+of\\s+|meaning\\s+of\\s+)"
    "(['‘’“”]?[a-zA-Z][\\w\\s\\-]*?)(?:\\s+mean(?:s|ing)?|\\?|$)|article\\s+4\\s*\\(\\s*(\\d+[a-z]?)\\s*\\))"
)
# Letters that only one language has.
LETTERS = {"pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "it": "àèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ"}
LONGEST_RANGE = 20


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_each(text: Column, pattern: str, change) -> Column:
    """The text with each match of ``pattern`` put through ``change``, in one pass."""

    def put(t: Column) -> Column:
        found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        return F.array_join(F.zip_with(between, found, lambda s, m: F.concat(s, F.coalesce(change(m), F.lit("")))), "")

    return let(text, put)


def expand(text: Column, terms: dict[str, str], any_case: bool) -> Column:
    """Each term followed by its expansion in brackets."""
    pattern = ("(?iU)" if any_case else "(?U)") + r"\b(?:" + "|".join(re.escape(t) for t in terms) + r")\b"
    book = F.create_map(*(F.lit(x) for pair in terms.items() for x in pair))
    key = (lambda m: F.lower(m)) if any_case else (lambda m: m)
    return replace_each(text, pattern, lambda m: F.concat(m, F.lit(" ("), F.element_at(book, key(m)), F.lit(")")))


def canonical_articles(text: Column) -> Column:
    return F.regexp_replace(text, CITED, "Article $1")


def expand_ranges(text: Column) -> Column:
    """``Articles 5 to 7`` as ``Article 5 Article 6 Article 7``; not if backwards or too long."""

    def listed(m: Column) -> Column:
        lo, hi = (F.regexp_extract(m, RANGE, i) for i in (1, 2))
        lo, hi = (F.regexp_extract(x, r"^(\d+)", 1).try_cast("long") for x in (lo, hi))
        good = (hi > lo) & (hi - lo <= LONGEST_RANGE)
        return F.when(good, F.array_join(F.transform(F.sequence(lo, F.greatest(lo, F.least(hi, lo + LONGEST_RANGE))), lambda n: F.concat(F.lit("Article "), n.cast("string"))), " ")).otherwise(m)

    return replace_each(text, RANGE, listed)


def normalise_query(text: Column) -> Column:
    """Abbreviations, article citations, ranges and synonyms, in this order."""
    text = canonical_articles(expand(text, ABBREVIATIONS, any_case=False))
    return expand(expand_ranges(text), SYNONYMS, any_case=True)


def strip_subordinate(text: Column) -> Column:
    """Without references that only support the question; untouched if there are none."""
    bare = F.regexp_replace(text, SUBORDINATE, "")
    tidy = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s{2,}", " "), r"(?U)\s+([,.;:?!])", "$1")
    tidy = F.regexp_replace(tidy, r"(?U)^\s+|\s+$", "")
    return F.when(text.rlike(SUBORDINATE), tidy).otherwise(text)


def direct_article(text: Column) -> Column:
    """The only article a query names, if it names just one of this document's."""

    def only(own: Column) -> Column:
        named = F.array_distinct(F.regexp_extract_all(own, F.lit(REFERENCE), F.lit(1)))
        return F.when(~own.rlike(COORDINATED) & (F.size(named) == 1), F.get(named, F.lit(0)))

    return let(F.regexp_replace(text, FOREIGN, ""), only)


def definition_signal(text: Column) -> Column:
    """``#N`` for a numbered definition, or a term of four words at most."""
    number, term = F.regexp_extract(text, DEFINITION, 2), F.regexp_extract(text, DEFINITION, 1)
    short = lambda t: F.when((t != "") & (F.size(F.split(F.trim(t), r"\s+")) <= 4), t)
    plain = F.regexp_replace(F.lower(F.trim(term)), "^['‘’“”]+|['‘’“”]+$", "")
    return let(number, lambda n: F.when(n != "", F.concat(F.lit("#"), n)).otherwise(let(plain, short)))


def detect_language(text: Column) -> Column:
    """By letters that only one of the languages has; English without any."""
    out = F.lit("en")
    for language in reversed(list(LETTERS)):
        out = F.when(text.rlike(f"[{LETTERS[language]}]"), F.lit(language)).otherwise(out)
    return out


def is_greeting(text: Column) -> Column:
    return text.rlike(GREETING)


def is_multi_hop(text: Column) -> Column:
    return text.rlike(MULTI_HOP)


def classified(text: Column) -> Column:
    """(kind, signal, article) of a question: its kind, its definition's signal and the article that it names; it is normalised once for all three."""

    def kind(s: Column) -> Column:
        direct = s["article"]
        defined = F.when(is_greeting(F.trim(text)), "CONVERSATIONAL").when(s["signal"].isNotNull() | (direct == "4"), "DEFINITION")
        return defined.when(direct.isNotNull(), "DIRECT_ARTICLE").otherwise("SPECIFIC")

    def parts(plain: Column) -> Column:
        return F.struct(definition_signal(plain).alias("signal"), direct_article(plain).alias("article"))

    read = let(normalise_query(text), parts)
    return let(read, lambda s: F.struct(kind(s).alias("kind"), s["signal"].alias("signal"), s["article"].alias("article")))


def classify(text: Column) -> Column:
    """CONVERSATIONAL, DEFINITION, DIRECT_ARTICLE or SPECIFIC; the first that holds."""
    return classified(text)["kind"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def title_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOPWORDS)))


def normalise_question(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def normalise_article(text: Column) -> Column:
    """``429A(1)`` as ``429a``."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"\(.*$", ""))


def article_family(text: Column) -> Column:
    return F.regexp_replace(normalise_article(text), r"^(\d+)[a-z]+$", "$1")


def article_order(article: Column) -> list[Column]:
    """Sort keys: the number, then its letters; what isn't a number comes last."""
    number = F.regexp_extract(article, r"^(\d+)", 1)
    return [F.when(number != "", number.try_cast("long")).otherwise(F.lit(999999)), F.regexp_extract(article, r"^\d+([a-z]*)", 1), article]
