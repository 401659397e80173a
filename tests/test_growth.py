"""What a query's joins and tasks hold doesn't outgrow its input."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvane import registry
from corvane.functions import language, text
from corvane.operators import context as c
from corvane.operators import graph as g
from corvane.queries import texts
from corvane.sources import html_tree, toc
from corvane.sources.postings import _blocks, _group_best

from .conftest import DATA


def test_a_walk_joins_few_edges_of_a_much_cited_article(spark):
    """An article that 500 others cite, twice each: a query takes the first that it hasn't seen or left out."""
    citing = [(str(i), "7", "general", pos) for i in range(100, 600) for pos in (0, 1)]
    edges = g.reversed_edges(spark.createDataFrame(citing, "src string, dst string, kind string, pos int"))
    seeds = spark.createDataFrame([(1, "7", 1), (1, "100", 2), (2, "7", 1)], "query_id int, article string, pos int")
    without = spark.createDataFrame([(2, "100"), (2, "101"), (2, "102")], "query_id int, article string")
    found = g.traverse(seeds, edges, 1, F.lit(2), exclude=without)
    assert sorted((r["query_id"], r["article"], r["rank"]) for r in found.collect()) == [(1, "101", 1), (1, "102", 2), (2, "103", 1), (2, "104", 2)]
    # 1 seed and 3 left out and 2 reached: no more of the 1,000 edges are joined.
    few = g._first_edges(edges.select("src", "dst", F.lit(3).alias("p"), F.col("pos").alias("e")), 6)
    assert sorted((r["dst"], r["e"]) for r in few.collect()) == [(str(i), 0) for i in range(100, 106)]


def _written(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_thresholds_are_searched_once_a_section(spark):
    row = spark.createDataFrame([("Article 5\n\nAt least 3% or 9 days", "Article 5 asks for 3%.")], "context string, answer string")
    for made, want in (
        (c.key_facts(F.col("context")), c.FACTS + "- Article 5: 3%, 9 days\n\n"),
        (c.missing_thresholds(F.col("context"), F.col("answer")), "Article 5: 9 days"),
        (c.completed(F.col("context"), F.col("answer")), "Article 5 asks for 3%." + c.NOTE + "Article 5: 9 days."),
    ):
        out = row.select(made.alias("x"))
        assert out.first()["x"] == want
        assert _written(out).count(r"basis\s+points") == 1


def test_a_question_is_normalised_once(spark):
    row = spark.createDataFrame([("What is the LCR under art. 4?",), ("See article 92",), ("Hello!",), (None,)], "q string")
    out = row.select(text.classified(F.col("q")).alias("c")).select("c.*")
    assert [tuple(r) for r in out.collect()] == [("DEFINITION", None, "4"), ("DIRECT_ARTICLE", None, "92"), ("CONVERSATIONAL", None, None), ("SPECIFIC", None, None)]
    once = _written(row.select(text.normalise_query(F.col("q")).alias("x")))
    assert _written(out).count("perpetual") == once.count("perpetual") > 0


def test_a_search_shuffles_no_row_for_each_query_and_node():
    """A group of nodes gives a query k rows at most, ties by id, and none where no term is shared."""
    part = pd.DataFrame({"node_id": [9, 3, 5, 7], "tid": [0, 0, 0, 1], "v": [1.0, 1.0, 1.0, 2.0]})
    blocks = _blocks(np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([1.0, 1.0, 1.0]), 3)
    out = _group_best(part, np.array([10, 20, 30]), blocks, 2, 6)
    assert [tuple(r) for r in out.itertuples(index=False)] == [(10, 3, 1.0), (10, 7, 2.0), (20, 7, 2.0)]


def test_pages_of_contents_are_parsed_once(spark):
    plan = registry.queries()["toc_entries"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    rows = spark.createDataFrame([(1, 0, "5", False), (1, 1, "5", False), (1, 2, "5", True), (1, 3, None, False)], "page_id long, pos int, article string, is_annex boolean")
    terms = spark.createDataFrame([("5", "five")], "article string, key_terms string")
    assert sorted((r["pos"], r["key_terms"]) for r in toc.with_key_terms(rows, terms, F.col("pos") > 0).collect()) == [(0, ""), (1, "five"), (2, ""), (3, "")]


def _shape(node):
    return node.tag, node.attrs, [_shape(c) if isinstance(c, html_tree.Node) else c for c in node.children]


def test_plain_pages_have_the_tokenizers_tree():
    """What the expression for plain pages cuts is what the standard tokenizer gives; it leaves all other pages."""
    some = ["<p>", "</p>", '<div class="a b">', "<div id='x' hidden>", "</div>", "<br>", "<br />", "<i/>", "<ul><li>", "</ul>", "text", " &amp; &lt x", "&", "<!-- c-d -->", "\n", '<a b="1" b="2">']
    odd = ["<!-->", " < ", "<A>", "<a b=c>", '<a b="1"c="2">', "<script>", "</script>", "<title>", "<!doctype html>", "<p", "</a >", "<a b='>'>", '<a b="&amp;">', "<a b/ c>"]
    r, plain = np.random.default_rng(1), 0
    for _ in range(5000):
        page = "".join(r.choice(some + odd if r.random() < 0.3 else some, 6))
        slow, fast = html_tree._Builder(), html_tree._Builder()
        slow.feed(page)
        slow.close()
        if html_tree._built(fast, page):
            plain += 1
            assert _shape(fast.root) == _shape(slow.root), page
        assert _shape(html_tree.parse(page)) == _shape(slow.root), page
    assert plain > 3000


def _languages(docs):
    """(doc_id, language, score) by counting every trigram in turn."""
    plain = {i: (x, f" {' '.join(''.join(c if c.isalpha() else ' ' for c in t.lower()).split())} ") for i, x, t in docs if t is not None}
    counts = {}
    for x, t in plain.values():
        for i in range(len(t) - 2) if x else ():
            counts.setdefault(x, {}).setdefault(t[i : i + 3], []).append(1)
    weight = {x: {g: round(1e6 * np.log((len(n) + 1) / (sum(map(len, c.values())) + 500))) for g, n in sorted(c.items(), key=lambda e: (-len(e[1]), e[0]))[:500]} for x, c in counts.items()}
    unseen = {x: round(1e6 * np.log(1 / (sum(map(len, c.values())) + 500))) for x, c in counts.items()}
    scores = {i: [(-sum(weight[x].get(t[j : j + 3], unseen[x]) for j in range(len(t) - 2)), x) for x in counts] for i, (_, t) in plain.items() if len(t) > 2}
    return sorted((i, min(s)[1], -min(s)[0]) for i, s in scores.items())


def test_trigrams_are_never_rows(spark, monkeypatch):
    """Texts in pieces, supplementary letters, and texts without a trigram, a text or a language; a row for each text leaves Python."""
    long = "the cat and the hat " * 40
    docs = [(1, "en", long), (2, "it", "il gatto e il cappello"), (3, None, "the hat"), (4, "en", ""), (5, "it", None), (6, "en", "\U00010400\U00010401 x\U00010402"), (7, "it", "a"), (8, "en", "..."), (9, "pl", "żółw")]
    df = spark.createDataFrame(docs, "doc_id long, language string, text string")
    found = language.identify(df, language.fit(df))
    assert sorted(tuple(r) for r in found.collect()) == _languages(docs)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert language.identify(df, language.fit(df.where("language = 'none'"))).count() == 0
    monkeypatch.setattr(language, "CHARS", 7)
    numbers = [language._as_grams(n) for n, _, _ in language._numbered([None, long, "ab", "abc", "abcd"])]
    assert sum(numbers, []) == [long[i : i + 3] for i in range(len(long) - 2)] + ["abc", "abc", "bcd"]
    known, gains = language._as_numbers(["abc", "bcd"]), np.array([[1, 10, 0]])
    sums = np.zeros(5, dtype=int)
    for n, rows, starts in language._numbered([None, "xabcd" * 5, "ab", "abc", "abcd"]):
        np.add.at(sums, rows, language._gains(n, starts, known, gains)[0])
    assert sums.tolist() == [0, 55, 0, 1, 11]


def test_tasks_of_sections_grow_with_lines(spark, monkeypatch):
    """No shuffle under a context or a threshold has the session's number of partitions, which doesn't grow; contexts are the same."""
    monkeypatch.setattr(texts, "LINES", 500)
    tasks = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert tasks > 10
    for name, shuffles in (("context_parents", 3), ("context_build", 2), ("threshold_extract", 1)):
        plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count(f", {tasks}), REPARTITION_BY_NUM") == shuffles, name
    hits = [(1, 1, 10, "7", "T", "en", "a"), (1, 2, 11, "7", None, "en", "b"), (1, 3, 12, "", None, "en", "c"), (1, 4, 13, None, "U", "en", "d"), (2, 1, 14, "7", None, "it", "e"), (2, 2, 15, "8", None, "en", None)]
    df = spark.createDataFrame(hits, "query_id int, rank int, node_id long, article string, article_title string, language string, text string")
    parents = spark.createDataFrame([("7", "en", "whole")], "article string, language string, text string")
    for book in (None, parents):
        some, more = (sorted(tuple(r) for r in c.build_context(df, book, n).collect()) for n in (None, 3))
        assert some == more and len(some) == 2
    assert some[0][1].startswith("Article 7 — T\n\nwhole" + c.SEPARATOR)
