"""Text and reference functions on the forms that the reference's own tests name."""

import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import refs, text
from corvane.operators import context, graph
from corvane.plans import providers


def ask(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, q string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("q"))).collect()]


def test_normalise_query(spark):
    got = ask(spark, text.normalise_query, "CET1 in art. 92", "Art 92a", "articles 5 to 8", "Articles 8 to 5", "cet1", "SEC-SA", "Core capital?", "Articles 1 to 40", None, "")
    assert got[:2] == ["CET1 (Common Equity Tier 1) in Article 92", "Article 92a"]
    assert got[2] == "Article 5 Article 6 Article 7 Article 8"
    assert got[3] == "Articles 8 to 5"
    assert got[4] == "cet1"
    assert got[5] == "SEC-SA (Securitisation Standardised Approach)"
    assert got[6] == "Core capital (Common Equity Tier 1)?"
    assert got[7] == "Articles 1 to 40"
    assert got[8:] == [None, ""]


def test_direct_article(spark):
    asked = ["Explain Article 92", "Article 92 and 93", "Article 10 of Directive 2014/59/EU", "Article 92 vs Article 92", "nothing", "Article 5 and Article 6"]
    assert ask(spark, text.direct_article, *asked) == ["92", None, None, "92", None, None]


def test_classify(spark):
    asked = ["Hello!", "What is an institution?", "Article 4(1)", "Explain Article 4", "Explain Article 92", "How much capital must a bank of this size hold?"]
    assert ask(spark, text.classify, *asked) == ["CONVERSATIONAL", "DEFINITION", "DEFINITION", "DEFINITION", "DIRECT_ARTICLE", "SPECIFIC"]


def test_definition_signal(spark):
    asked = ["What does own funds mean?", "Article 4(1)(5a)", "define leverage", "What is the one very long phrase with many words here?"]
    assert ask(spark, text.definition_signal, *asked)[0] == "own funds"
    assert ask(spark, text.definition_signal, *asked)[2:] == ["leverage", None]


def test_strip_subordinate(spark):
    got = ask(spark, text.strip_subordinate, "Assets deducted as per Article 36(1)(d) , held", "plain  text", "x\n\nunder Article 7(1) \n")
    assert got == ["Assets deducted, held", "plain  text", "x"]


def test_languages(spark):
    assert ask(spark, text.detect_language, "łódź", "perché", "plain", "ł è") == ["pl", "it", "en", "pl"]


def test_article_refs(spark):
    asked = [
        "As defined in Article 26 and Article 36, institutions shall comply with Articles 89, 90 and 91. See also Directive 2013/36/EU and Regulation (EU) No 648/2012.",
        "Article 10 of Directive 2013/36/EU",
        "Articles 3 to 6",
        "Articles 429a, 429 and 430",
        "",
    ]
    assert ask(spark, refs.article_refs, *asked) == [["26", "36", "89", "90", "91"], [], ["3", "4", "5", "6"], ["429", "429a", "430"], []]
    assert ask(spark, refs.external_refs, asked[0]) == [["Directive 2013/36/EU", "Regulation (EU) No 648/2012"]]


def test_structure(spark):
    assert ask(spark, lambda c: refs.structural_refs(c, "Part", True), "Part Three and Part II", "Parts One to Three", "none") == [["II", "III"], ["I", "II", "III"], []]
    assert ask(spark, lambda c: refs.structural_refs(c, "Chapter", False), "Chapter 2 or Chapters 4, 5 and 6") == [["2", "4", "5", "6"]]
    assert ask(spark, refs.annex_refs, "Annexes I, III and IV; Annex II") == [["I", "II", "III", "IV"]]
    row = spark.createDataFrame([("prt_III.tis_I.cpt_1.sct_2",)], "p string").select(*(c.alias(n) for n, c in refs.hierarchy(F.col("p")).items())).first()
    assert tuple(row) == ("III", "I", "1", "2", None)


def test_uuid5(spark):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = ["art_92_en", "é", ""]
    assert ask(spark, lambda c: refs.uuid5(c, space), *names) == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]


def test_reference_kinds(spark):
    rows = [("subject to Article 5 and more", "5"), ("calculated pursuant to Article 7.", "7"), ("see Article 9", "9"), ("as defined in Article 4", "4"), ("no mention", "3"), ("referred to in Article 12, " + "x" * 200 + " subject to Article 12", "12")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, a string").orderBy("i")
    got = [r[0] for r in df.select(graph.classify_reference(F.col("t"), F.col("a"))).collect()]
    assert got == ["prerequisite", "procedural", "general", "definition", "general", "back_reference"]


def test_thresholds(spark):
    asked = "At least 4.5% of EUR 5 million within 30 calendar days, 25 basis points, 4.5%"
    assert ask(spark, context.thresholds, asked, "") == [["25 basis points", "30 calendar days", "4.5%", "EUR 5 million"], []]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab-\n", max_size=60), st.integers(1, 40))
def test_truncate(spark, s, most):
    got = ask(spark, lambda c: context.truncate(c, most), s)[0]
    if len(s) <= most:
        want = s
    else:
        cut = s[:most].rfind(context.SEPARATOR)
        want = s[:cut] if cut > 0 else s[:most]
    assert got == want


def test_parsers(spark):
    assert ask(spark, providers.parse_sub_questions, "1. a\n2) b\n\n- c\n4. d") == [["a", "b", "c"]]
    assert ask(spark, providers.parse_routes, '{"articles": ["92", "x", "429a"]}', "see 92 and 93", '["5"]') == [["92", "429a"], ["92", "93"], ["5"]]
    row = spark.createDataFrame([("PASSAGE: one\ntwo\nARTICLES: 92, 93",)], "t string").select(*(c.alias(n) for n, c in providers.parse_passage(F.col("t")).items())).first()
    assert tuple(row) == ("one\ntwo", "92, 93")
    assert [x["a"] for x in ask(spark, lambda c: providers.salvage_json(c, "struct<a:int>"), '```json\n[{"a": 1}, {"a": 2}]\n```')[0]] == [1, 2]
    assert [x["a"] for x in ask(spark, lambda c: providers.salvage_json(c, "struct<a:int>"), 'text {"a": 3} more {"a": 4}')[0]] == [3, 4]


@pytest.mark.parametrize("a,want", [("429A(1)", "429a"), ("26(1)", "26"), (" 92 ", "92")])
def test_article_normalise(spark, a, want):
    assert ask(spark, text.normalise_article, a) == [want]
    assert ask(spark, text.article_family, a) == [re.sub("[a-z]+$", "", want)]
