"""Reports' forms, formulas, and the files of runs."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import formulas as fm
from corvane.operators import reports
from corvane.sources import runs


def test_formulas(spark):
    texts = ["a $x$ b $$y\nz$$ c \\[w\\]", "costs $5", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fm.formulas(F.col("t"))).collect()]
    assert got == [["$x$", "$$y\nz$$", "\\[w\\]"], [], [], None]
    marked = spark.createDataFrame([("[FORMULA_1] [FORMULA_0] [FORMULA_0] [FORMULA_2]", ["$a$", "\\1$b$"]), ("[FORMULA_0]", [])], "t string, f array<string>")
    assert [r[0] for r in marked.select(fm.with_formulas(F.col("t"), F.col("f"))).collect()] == ["\\1$b$ $a$ [FORMULA_0] [FORMULA_2]", "[FORMULA_0]"]


def test_lists(spark):
    rows = spark.createDataFrame([("192, 93", "92"), ("92 ,", "92"), (None, "92")], "c string, m string")
    assert [r[0] for r in rows.select(fm.lists(F.col("c"), F.col("m"))).collect()] == [False, True, False]


def test_languages(spark):
    assert runs.language("pl").headings["SECTION"] == ("PODSEKCJA", "SEKCJA")
    with pytest.raises(ValueError, match="en, it, pl"):
        runs.language("de")
    nodes = spark.createDataFrame([("n", "ARTICLE", "t", "x")], "node_id string, level string, article_title string, text string")
    assert runs.embedded(nodes).columns == ["article_title", "text"]


def test_run_files(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("a_summary.json", "b_state.json", "b_cases.jsonl"):
        runs.write_state(spark, f"{folder}/{name}", "{}")
    runs.write_state(spark, f"{folder}/b_state.json", '{"at": "é"}')
    assert (tmp_path / "b_state.json").read_text() == '{"at": "é"}' and not (tmp_path / "b_state.json.tmp").exists()
    assert [tuple(r) for r in runs.runs(runs.run_files(spark, folder)).collect()] == [("b", False)]
    runs.write_state(spark, f"{folder}/a_cases.jsonl", "{}")
    assert {tuple(r) for r in runs.runs(runs.run_files(spark, folder)).collect()} == {("a", True), ("b", False)}


def test_cached_builds_once(spark, tmp_path):
    built = []
    make = lambda: built.append(1) or spark.range(3)
    assert [runs.cached(spark, f"{tmp_path}/t", make).count() for _ in range(2)] == [3, 3] and built == [1]


def test_empty_tables(spark):
    cases = spark.createDataFrame([], "id long, status string, error_type string, error_message string")
    assert reports.error_breakdown(cases).count() == 0
    assert reports.box_figures(spark.createDataFrame([("a", None)], "k string, v double"), "k", "v").count() == 0
    flags = spark.createDataFrame([(None,), ([],), ([("high",)],)], "f array<struct<severity string>>")
    assert [r[0] for r in flags.select(reports.needs_review(F.col("f"))).collect()] == [False, False, True]
