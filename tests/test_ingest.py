"""Pages to nodes, the index table, case files and streams."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from corvane.sources import case_files, index_table, legal_html
from corvane.streaming import ingest

from .conftest import DATA

PAGE = """<html><head><style>p {}</style></head><body><footer>imprint</footer>
<div id="prt_II.tis_IV.cpt_3.sct_2">
<div id="art_17b"><p class="title-article-norm">Article 17b</p><div class="eli-title"><p class="stitle-article-norm">Bakery weights</p></div>
<p class="norm">Bakers weigh loaves under Article 21 and Annex II.</p>
<table class="borderOj"><tr><td>Loaf</td><td>Grams|ounces</td></tr><tr><td>rye</td><td>750</td></tr></table>
<div class="norm"><span class="no-parag">1.</span>Scales are tested yearly, as Articles 30 to 32 say.<div class="grid-container grid-list">
<div class="grid-row"><div><span>(i)</span></div><div><p>spring scales ◄ twice;</p></div></div><div class="grid-row"><div>(ii)</div><div>beam scales once.</div></div></div></div>
<p class="modref">►C1</p><p>Weight is <img src="data:image/gif;base64,q"> times the count.</p></div>
<div id="art_18"> </div></div>
<div id="anx_III"><p class="title-annex-1">ANNEX III</p><p class="title-annex-2">Forms</p><div>Form of a <b>test</b> record.</div></div></body></html>"""


def nodes(spark, html):
    return legal_html.nodes(spark.createDataFrame([(1, "en", html)], "page_id long, language string, html string"))


def test_article(spark):
    by = {r["node_id"]: r for r in nodes(spark, PAGE).collect()}
    assert set(by) == {"art_17b_en", "anx_III_en"}
    a = by["art_17b_en"]
    assert a["text"].split("\n") == [
        "Bakers weigh loaves under Article 21 and Annex II.",
        "[TABLE]",
        "| Loaf | Grams\\|ounces |",
        "| --- | --- |",
        "| rye | 750 |",
        "1. Scales are tested yearly, as Articles 30 to 32 say.",
        "  (i) spring scales ;",
        "  (ii) beam scales once.",
        "Weight is [FORMULA_0] times the count.",
    ]
    assert (a["part"], a["title"], a["chapter"], a["section"], a["sub_article_of"]) == ("II", "IV", "3", "2", "17")
    assert a["article_title"] == "Bakery weights" and a["has_table"] and a["has_formula"]
    assert a["referenced_articles"] == ["21", "30", "31", "32"] and a["referenced_annexes"] == ["II"]
    assert a["embedding_text"].startswith("Part II > Title IV > Chapter 3 > Section 2 > Article 17b — Bakery weights\n\nBakers")
    assert by["anx_III_en"]["annex_title"] == "Forms" and by["anx_III_en"]["chunk_type"] == "ARTICLE"


def test_paragraphs_and_empty(spark):
    words = " ".join(["word"] * 60)
    page = f'<div id="prt_I"><div id="art_1"><div class="norm"><span class="no-parag">1.</span>{words} as in Article 7</div><div class="norm"><span class="no-parag">2.</span>{words}</div></div><div id="art_2"></div></div>'
    got = {r["node_id"]: r for r in nodes(spark, page).collect()}
    assert set(got) == {"art_1_en", "art_1_p1_en", "art_1_p2_en"}
    assert got["art_1_p2_en"]["referenced_articles"] == ["7"] and got["art_1_p2_en"]["parent_article_id"] == "art_1_en"
    assert nodes(spark, "<p>no articles</p>").count() == 0
    assert nodes(spark, None).count() == 0


def test_index(spark):
    path = tempfile.mkdtemp() + "/index"
    schema = "key string, language string, chunk_type string, text string"
    index_table.create(spark.createDataFrame([("a", "en", "ARTICLE", "1"), ("b", "it", "ARTICLE", "2")], schema), path)
    index_table.upsert(spark, path, spark.createDataFrame([("a", "en", "ARTICLE", "3"), ("c", "en", "PARAGRAPH", "4")], schema))
    index_table.upsert(spark, path, spark.createDataFrame([("a", "en", "ARTICLE", "3")], schema))
    assert {(r["key"], r["text"]) for r in spark.read.parquet(path).collect()} == {("a", "3"), ("b", "2"), ("c", "4")}
    scan = index_table.scan(spark, path, language="en", chunk_type="ARTICLE")
    assert [r["key"] for r in scan.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(language" in scan._jdf.queryExecution().toString()


def test_cases(spark):
    folder = tempfile.mkdtemp()
    lines = [{"id": "a", "question": "one"}, {"id": "b", "question": "two"}, {"question": "none"}, {"id": "a", "question": "last"}]
    with open(folder + "/c.jsonl", "w") as f:
        f.write("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = case_files.read_cases(spark, folder + "/c.jsonl").orderBy("pos").collect()
    assert [(r["id"], r["question"]) for r in got] == [("a", "last"), ("b", "two")]
    with open(folder + "/case_007.md", "w") as f:
        f.write("# Case\n## Question\nwhat\n\n## Answer\nthat\nand this\n")
    parts = case_files.read_feedback(spark, folder + "/case_007.md").orderBy("section").collect()
    assert [(r["case"], r["section"], r["body"]) for r in parts] == [("case_007", "Answer", "that\nand this"), ("case_007", "Question", "what")]


def test_streams(spark):
    folder = tempfile.mkdtemp()
    source = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(f"{DATA}/events.parquet*")
    q = ingest.windowed(source).writeStream.outputMode("append").format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(folder + "/out").collect()}
    assert got and got <= {tuple(r) for r in ingest.windowed(spark.read.parquet(f"{DATA}/events.parquet")).collect()}
    os.makedirs(folder + "/in")
    schema = "key string, language string, chunk_type string, text string"
    index_table.create(spark.createDataFrame([("a", "en", "ARTICLE", "old")], schema), folder + "/index")
    spark.createDataFrame([("a", "en", "ARTICLE", "new"), ("b", "en", "ARTICLE", "x")], schema).write.parquet(folder + "/in/1")
    ingest.upsert_stream(spark.readStream.schema(schema).parquet(folder + "/in/*"), folder + "/index", folder + "/cp2").awaitTermination(60)
    assert {(r["key"], r["text"]) for r in spark.read.parquet(folder + "/index").select("key", "text").collect()} == {("a", "new"), ("b", "x")}


def test_answer_plan(spark):
    from corvane.plans import answer

    rows = [(1, "92", "Own funds requirements", "Institutions shall at all times satisfy own funds requirements of 8%."), (2, "93", "Initial capital", "Initial capital is required of institutions."), (3, "4", "Definitions", "Definitions of terms.")]
    docs = spark.createDataFrame(rows, "node_id long, article string, article_title string, text string").selectExpr("*", "'en' AS language", "'ARTICLE' AS chunk_type", "'ARTICLE' AS level")
    edges = spark.createDataFrame([("92", "93", "procedural", 0)], "src string, dst string, kind string, pos int")
    asked = spark.createDataFrame([(1, "Hello!"), (2, "Explain Article 93"), (3, "own funds requirements of institutions at all times")], "query_id long, query string")
    got = {r["query_id"]: r for r in answer.answer(asked, docs, edges, answer.Settings(cutoff=0.0)).collect()}
    assert got[1]["kind"] == "CONVERSATIONAL" and got[1]["answer"].startswith("Hello")
    assert got[2]["context"].startswith("Article 93 — Initial capital") and got[2]["confidence"] == 1.0
    assert got[3]["answer"].startswith("Article 92")
    assert F is not None
