"""Tables of contents, runs of references, languages, and small sources and sinks."""

import tempfile

from pyspark.sql import functions as F

from corvane.functions import language, refs
from corvane.operators import context, retrieval
from corvane.sources import case_files, runs, toc

from .conftest import DATA

ITEM, LINK = '<li><div class="isrb-tree-item">{0}</div>{1}</li>', '<li><div class="contextual-region"><a>{0}</a></div></li>'


def test_toc_places():
    section = ITEM.format("Section 4: weights", "<ul>" + LINK.format("Article 111 b - Loaves") + ITEM.format("Sub-section 1: rye", "<ul>" + LINK.format("ARTICLE 112: Rye") + "</ul>") + "</ul>")
    chapter = ITEM.format("Chapter 2: bakers", f"<ul>{section}" + LINK.format("Article 113: Scales") + "</ul>")
    title = ITEM.format("TITLE ii: trade", f"<ul>{chapter}" + LINK.format("Article 114: Fairs") + "</ul>")
    page = '<ul><li><a>Article 1: menu</a></li></ul><div id="block-isrb-tree"><ul>' + ITEM.format("Part TWO: all", f"<ul>{title}</ul>") + ITEM.format("PART ONE A: some", "<ul>" + LINK.format("Article 9: Last") + "</ul>") + LINK.format("Annex iv: Forms") + LINK.format("About") + "</ul></div>"
    got = [(e["article"], e["article_title"], e["part"], e["title"], e["chapter"], e["section"], e["is_annex"]) for e in toc.leaves(page)]
    assert got == [
        ("111b", "Loaves", "TWO", "II", "2", "4", False),
        ("112", "Rye", "TWO", "II", "2", "4", False),
        ("113", "Scales", "TWO", "II", "2", "", False),
        ("114", "Fairs", "TWO", "II", "", "", False),
        ("9", "Last", "ONE A", "", "", "", False),
        ("ANNEX_IV", "Forms", "", "", "", "", True),
    ]
    assert list(toc.leaves("<ul><li><a>Article 1: no block</a></li></ul>")) == list(toc.leaves(None)) == []
    deep = "<ul>" + '<li><div class="isrb-tree-item">x</div><ul>' * 3000 + LINK.format("Article 1: deep")
    assert [e["article"] for e in toc.leaves(f'<div class="view-id-isrb_tree">{deep}')] == ["1"]


def test_toc_rows(spark):
    pages = spark.createDataFrame([(1, '<div id="block-isrb-tree"><ul>' + LINK.format("Article 5: Five") + LINK.format("ANNEX I: One")), (2, None), (3, "<p>")], "page_id long, html string")
    rows = toc.with_key_terms(toc.entries(pages), spark.createDataFrame([("5", "five words"), ("ANNEX_I", "no")], "article string, key_terms string"))
    assert sorted((r["page_id"], r["pos"], r["article"], r["key_terms"]) for r in rows.collect()) == [(1, 0, "5", "five words"), (1, 1, "ANNEX_I", "")]


RUNS = {
    "see Article 92 for details": ["92"],
    "vedi Articolo 92 per i dettagli": ["92"],
    "vedi Articoli 92 e 93": ["92", "93"],
    "Articolo 4 del Regolamento (UE) n. 648/2012": [],
    "Article 4 of Regulation (EU) No 648/2012 and Articles 5, 6a or 7": ["5", "6a", "7"],
    "Articles 3 and 4 to 9 of Directive 1; Article 10 on fairs": ["10"],
    "article 1 of Article 2": ["1", "2"],
    "Articlé 8, Particle 9": [],
    "": [],
    None: [],
}


def test_runs_rejoin(spark):
    df = spark.createDataFrame([(t,) for t in RUNS], "text string").select("text", refs.reference_runs(F.col("text")).alias("runs"))
    for r in df.collect():
        assert [x["value"] for x in r["runs"] or [] if x["kind"] == "article"] == RUNS[r["text"]]
        assert "".join(x["value"] for x in r["runs"] or []) == (r["text"] or "")
        assert all(r["text"][x["start"] :].startswith(x["value"]) and x["value"] for x in r["runs"] or [])


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.col("lang").alias("language"))
    profiles = language.fit(docs.where("doc_id % 5 <> 0"))
    held = docs.where("doc_id % 5 = 0 and length(text) > 100").select("doc_id", F.col("language").alias("want"))
    right = language.identify(docs, profiles).join(held, "doc_id").agg(F.avg((F.col("language") == F.col("want")).cast("int"))).first()[0]
    assert right > 0.95
    assert profiles.groupBy("language").count().agg(F.max("count")).first()[0] <= language.MOST_GRAMS + 1


QUESTIONS = {
    "What are the own funds requirements for institutions?": "en",
    "How does the leverage ratio relate to large exposures": "en",
    "Quali sono i requisiti di fondi propri per gli enti": "it",
    "Come si calcola il coefficiente di leva finanziaria": "it",
    "Jakie są wymogi w zakresie funduszy dla instytucji": "pl",
    "Jak oblicza sie wskaznik dla instytucji": "pl",
    "perché": "it",
    "": "en",
    "92": "en",
}


def test_language_of_questions(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "q string").select("q", language.of_question(F.col("q")).alias("language"))
    assert {r["q"]: r["language"] for r in df.collect()} == QUESTIONS


def test_outline_crosses_parts(spark):
    rows = [("en", i, str(i), f"T{i}", p, t, c, "", False) for i, (p, t, c) in enumerate([("ONE", "I", ""), ("ONE", "I", "1"), ("ONE", "", ""), ("TWO", "I", "1"), ("TWO", "I", "1")])] + [("en", 9, "II", "Forms", "", "", "", "", True)]
    df = spark.createDataFrame(rows, "language string, pos int, article string, article_title string, part string, title string, chapter string, section string, is_annex boolean")
    lines = [r["lines"] for r in context.outline(df).orderBy("is_annex", "pos").collect()]
    assert lines[0].split("\n")[:2] == ["Part ONE", "  Title I"] and lines[3].split("\n")[:3] == ["Part TWO", "  Title I", "    Chapter 1"] and "\n" not in lines[4]


def test_single_references(spark):
    texts = {"Article 17a and Articles 3 of this, article 3": ["3", "17a"], "Article 9 of Directive 1": [], "Article 9 to 12 of Regulation 1, Article 100": ["100"], "none": [], "": []}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", refs.single_refs(F.col("t")).alias("r"))
    assert {r["t"]: r["r"] for r in df.collect()} == texts


def test_source_chips(spark):
    rows = [(1, 1, 10, "92", "it", "en"), (1, 2, 11, "92", "en", "en"), (1, 3, 12, "92", "en", "en"), (1, 4, 13, "7", None, "en"), (1, 5, 14, "", "en", "en"), (2, 1, 15, "92", "it", None), (2, 2, 16, None, "it", None)]
    df = spark.createDataFrame(rows, "query_id int, rank int, node_id long, article string, language string, query_language string")
    got = sorted((r["query_id"], r["rank"], r["article"], r["node_id"]) for r in retrieval.source_chips(df).collect())
    assert got == [(1, 1, "92", 11), (1, 2, "7", 13), (2, 1, "92", 15)]


def test_case_counts_and_choice(spark):
    rows = [("a", "error", 1), ("a", "ok", 2), ("b", "ok", 3), ("c", None, 4), (None, "ok", 5)]
    assert case_files.id_counts(spark.createDataFrame(rows, "id string, status string, line int"), "line").collect()[0].asDict() == {"cases": 3, "ok": 1, "error": 2}
    cases = spark.createDataFrame([("a", "Easy", 3), ("b", "hard", 1), ("c", "easy", 2)], "id string, difficulty string, pos int")
    assert [r["id"] for r in case_files.chosen_cases(cases, ["a", "c"], difficulty="EASY", limit=1).collect()] == ["c"]
    assert case_files.chosen_cases(cases).count() == 3 and case_files.chosen_cases(cases, []).count() == 0


def test_pages_and_feedback_files(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    with open(base + "/a.html", "wb") as f:
        f.write("<p>caf\u00e9".encode() + b"\xff</p>")
    page = runs.read_pages(spark, base + "/*.html", "it").collect()[0]
    assert (page["html"], page["language"]) == ("<p>caf\u00e9\ufffd</p>", "it") and page["url"].endswith("a.html")
    rows = [("case_001", 0, "Question", "what\nnow"), ("case_001", 1, "Answer", "that"), ("case_012", 0, "Question", "why")]
    case_files.write_feedback(spark.createDataFrame(rows, "case string, pos int, section string, body string"), base + "/cases")
    got = sorted((r["case"], r["section"], r["body"]) for r in case_files.read_feedback(spark, base + "/cases/*/*").collect())
    assert got == sorted((c, s, b) for c, _, s, b in rows)
