"""Rewriting, sub-questions and judging in the answer plan."""

from pyspark.sql import functions as F

from corvane.plans import answer as plan
from corvane.plans.providers import Providers

NODES = "node_id string, text string, language string, article string, article_title string, chunk_type string, level string"


def nodes(spark):
    texts = {"1": "capital buffers apply to institutions", "2": "liquidity coverage of large exposures", "3": "leverage ratio reports", "4": "unrelated words only"}
    return spark.createDataFrame([(f"n{a}", t, None, a, None, "ARTICLE", "ARTICLE") for a, t in texts.items()], NODES)


def hits(spark, providers, question):
    asked = plan.classify(spark.createDataFrame([(7, question)], "query_id long, query string"), providers).withColumn("multi_hop", F.lit(True))
    got = plan.rank_parts(asked, nodes(spark), plan.Settings(providers=providers, cutoff=0.0))
    return [(r["query_id"], r["node_id"], r["score"]) for r in got.orderBy("rank").collect()]


def test_sub_questions_are_merged(spark):
    alone = hits(spark, Providers(), "capital buffers apply to institutions")
    none = hits(spark, Providers(sub_questions=lambda q: F.array().cast("array<string>")), "capital buffers apply to institutions")
    assert none == alone and alone[0][:2] == (7, "n1")
    parts = Providers(sub_questions=lambda q: F.array(F.lit("liquidity coverage of large exposures"), F.lit(" ")))
    both = hits(spark, parts, "capital buffers apply to institutions")
    assert {n for _, n, _ in both[:2]} == {"n1", "n2"} and {q for q, _, _ in both} == {7}
    assert len(both) == len({n for _, n, _ in both}) and [s for *_, s in both] == sorted((s for *_, s in both), reverse=True)


def test_rewritten_question(spark):
    p = Providers(rewrite=lambda q: F.when(q == "that one?", F.lit("leverage ratio reports")))
    assert hits(spark, p, "that one?")[0][1] == "n3"
    assert hits(spark, p, "capital buffers apply to institutions")[0][1] == "n1"


def test_judgement(spark):
    p = Providers(judge=lambda a, r: F.when(a == r, 1.5).when(a != "?", -1.0))
    answers = spark.createDataFrame([(1, "x"), (2, "y"), (3, "?"), (4, "x"), (5, None)], "query_id long, answer string")
    references = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (5, "x")], "query_id long, reference string")
    got = plan.judged(answers, references, plan.Settings(providers=p))
    assert {r["query_id"]: r["judgement"] for r in got.collect()} == {1: 1.0, 2: 0.0, 3: None, 4: None, 5: None}


RICH = "node_id long, language string, article string, article_title string, text string, refs string, annex_refs string, annex_id string, level string, chapter string"
FACTS = [
    (1, "en", "92", "Own funds requirements", "Institutions shall satisfy own funds requirements of 8% at all times.", "26", "II", None, "ARTICLE", "1"),
    (2, "en", "93", "Initial capital", "The own funds of institutions may not fall below initial capital.", "92", None, None, "ARTICLE", "1"),
    (3, "en", "26", "Common equity items", "Capital instruments qualify as common equity.", "28", None, None, "ARTICLE", "2"),
    (4, "en", "28", "Conditions", "Instruments are paid up.", None, None, None, "ARTICLE", "2"),
    (5, "en", "411", "Leakage of deposits", "Retail deposits leak slowly under stress.", "92", None, None, "ARTICLE", "3"),
    (6, "en", "7", "Derogation", "Permission is given by authorities to subsidiaries.", None, None, None, "ARTICLE", "4"),
    (7, "it", "92", "Requisiti di fondi propri", "Gli enti soddisfano sempre i requisiti di fondi propri.", None, None, None, "ARTICLE", "1"),
    (8, "en", None, "Forms", "Forms of own reports.", None, None, "II", "ANNEX", None),
    (9, "en", "4", "Definitions", "For this text, (1) words.", None, None, None, "ARTICLE", "1"),
]
ASKED = {
    1: ("Hello", None),
    2: ("What is the definition of institution?", None),
    3: ("Explain Article 4", None),
    4: ("Explain Article 93", None),
    5: ("Explain Article 999", None),
    6: ("Which own funds requirements do institutions satisfy, deducted under Article 7(1)?", None),
    7: ("Quali sono i requisiti di fondi propri per gli enti", None),
    8: ("and how slowly?", "Q: What leaks under stress?\nA: Deposits"),
    9: ("What is the definition of zebra?", None),
    10: ("own funds requirements of institutions at all times", None),
}


def test_every_route(spark):
    nodes = spark.createDataFrame(FACTS, RICH).selectExpr("*", "'ARTICLE' AS chunk_type", "node_id AS pos")
    edges = spark.createDataFrame([("92", "26", "procedural", 0), ("93", "92", "general", 0), ("26", "28", "general", 0)], "src string, dst string, kind string, pos int")
    definitions = spark.createDataFrame([("en", "1", "institution", "a credit institution"), ("en", "2", "bank", "a bank")], "language string, number string, term string, text string")
    asked = spark.createDataFrame([(i, q, h) for i, (q, h) in ASKED.items()], "query_id long, query string, history string")
    p = Providers(
        follow_up=lambda q, h: F.when(q.startswith("and how"), F.lit("how slowly do retail deposits leak under stress")),
        route=lambda q: F.when(q.contains("zebra"), F.array(F.lit("411"))).otherwise(F.array().cast("array<string>")),
        answer=lambda q, c: F.concat(F.lit("said of "), q),
    )
    settings = plan.Settings(providers=p, cutoff=0.05)
    corpus = plan.Corpus.build(nodes, p, edges, definitions)
    got = {r["query_id"]: r for r in plan.answer(asked, corpus, settings=settings).collect()}
    assert set(got) == set(ASKED)
    heads = {i: [s.split("\n")[0] for s in (r["context"] or "").split("\n\n---\n\n")] for i, r in got.items()}
    assert (got[1]["prompt"], got[1]["answer"], got[1]["context"]) == ("conversational", plan.GREETING, None)
    assert got[2]["answer"] == "**Article 4(1) — Definition of 'institution'**\n\na credit institution" and got[2]["prompt"] == "definition"
    assert "contains 2 definitions including: institution, bank" in got[3]["answer"]
    assert heads[4][0] == "Article 93 — Initial capital" and got[4]["confidence"] == 1.0 and got[4]["prompt"] == "default"
    assert "Article 92 — Own funds requirements" in heads[4][1:]  # what the one hit refers to
    assert got[5]["context"] and got[5]["confidence"] != 1.0  # no such article: searched
    assert heads[6][0] == "Article 92 — Own funds requirements"  # the article named only supports the question
    assert heads[7][0] == "Article 92 — Requisiti di fondi propri" and all("Own funds" not in h for h in heads[7])
    assert heads[8][0] == "Article 411 — Leakage of deposits" and got[8]["answer"] == "said of how slowly do retail deposits leak under stress"
    assert got[9]["prompt"] in ("default", "fallback") and "Article 411 — Leakage of deposits" in heads[9]  # routed by the table of contents
    assert heads[10][0] == "Article 92 — Own funds requirements" and "Article 26 — Common equity items" in heads[10] and any("Forms" in h for h in heads[10])
    both = plan.Settings(providers=p, cutoff=0.05, global_rerank=True)
    again = {r["query_id"]: r for r in plan.answer(asked.where("query_id in (4, 10)"), corpus, settings=both).collect()}
    assert again[10]["context"].startswith("Article 92") and set(again) == {4, 10}


def test_written_passage_and_hints(spark):
    asked = spark.createDataFrame([(1, "how much must banks hold"), (2, "Explain Article 92")], "query_id long, query string")
    form = lambda p: {r["query_id"]: r["normalised"] for r in plan.classify(asked, p).collect()}
    got = form(Providers(hypothesis=lambda q: F.lit("PASSAGE: Institutions hold own funds.\nARTICLES: 92, 93")))
    assert got == {1: "Institutions hold own funds. [Relevant CRR articles: 92, 93]", 2: "Explain Article 92"}
    assert form(Providers(hints=lambda q: F.lit(" 92 ")))[1] == "how much must banks hold [Relevant CRR articles: 92]"
    assert form(Providers(hints=lambda q: F.lit("don't know!")))[1] == "how much must banks hold"
