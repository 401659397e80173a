"""Stored indexes and versioned tables: exact against all pairs and counts, upserts, merges, patches and switches."""

import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.sources import dense_index, index_table, postings
from corvane.sources.bucket_table import BucketTable
from corvane.sources.dense_index import DenseIndex
from corvane.sources.workspace import Conflict, Versions
from corvane.streaming import ingest

NODES = "node_id long, vector array<double>, language string"


def folder():
    return tempfile.mkdtemp(prefix="spark-") + "/index"


def all_pairs(queries, nodes, k, keep_self=False, keep=lambda n: True):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    fine = lambda v: v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = []
    for q, v in queries:
        if fine(v):
            scored = [(-(round(float(unit(v) @ unit(w)), 6) + 0.0), n) for n, w, lang in nodes if fine(w) and keep(lang) and (keep_self or n != q)]
            out += [(q, n, -s, r + 1) for r, (s, n) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_ROWS": 7, "MOST_SENT": 400}])
def test_dense_index_as_all_pairs(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(dense_index, name, value)
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    near = lambda: [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]
    nodes = [(i, near(), rng.choice(["en", "it"])) for i in range(300)] + [(1000 + i, centres[0], "en") for i in range(60)]
    nodes += [(2000, None, "en"), (2001, [0.0] * 6, "en"), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], "en"), (2003, [float("nan")] * 6, "en"), (2004, [1.0] * 3, "en"), (2005, [], "it")]
    queries = [(i, nodes[i][1]) for i in range(0, 360, 17)] + [(5000, None), (5001, [0.0] * 6), (5002, [2.0] * 6)]
    built = DenseIndex.build(spark.createDataFrame(nodes, NODES), folder(), keys=("language",))
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    for k in (1, 5, 70, 1000):
        hits, reads = built.search(asked, k)
        assert rows_of(hits, "query_id", "node_id", "score", "rank") == all_pairs(queries, nodes, k)
        read = {r["query_id"]: r["vectors"] for r in reads.collect()}
        assert set(read) == {q for q, v in queries if v and any(v)}
        if k == 5:  # cells far from a query are not read
            assert sum(read.values()) < 0.6 * 360 * len(read)
    hits, _ = built.search(asked, 5, where=F.col("language") == "it", keep_self=True)
    assert rows_of(hits, "query_id", "node_id", "score", "rank") == all_pairs(queries, nodes, 5, True, lambda x: x == "it")
    plan = built.search(asked, 5)[0]._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = DenseIndex.build(spark.createDataFrame([], NODES), folder())
    assert empty.search(asked, 3)[0].count() == 0 and built.search(asked.limit(0), 3)[0].count() == 0


WORDS = "own funds capital ratio large exposure bank of the".split()


def brute_bm25(queries, docs, k):
    words = {i: postings_words(t) for i, t in docs.items()}
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words))
    out = []
    for q, text in queries:
        scores = {}
        for t in set(postings_words(text)):
            having = [i for i, w in words.items() if t in w]
            idf = np.log(1 + (n - len(having) + 0.5) / (len(having) + 0.5))
            for i in having:
                tf = words[i].count(t)
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        out += [(q, i, r + 1) for r, (s, i) in enumerate(sorted((-round(s, 6), i) for i, s in scores.items())[:k])]
    return sorted(out)


def postings_words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def test_postings_upsert_merge(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))
    docs = {i: text() for i in range(80)} | {80: None, 81: "", 82: "the the the"}
    frame = lambda d: postings.of_texts(spark.createDataFrame(list(d.items()), "node_id long, text string"))
    queries = [(0, "own funds"), (1, "The RATIO of the bank"), (2, "unheard"), (3, ""), (4, None)]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    index = postings.Postings.create(frame(docs), folder())
    found = lambda: rows_of(index.bm25(asked, 7), "query_id", "node_id", "rank")
    assert found() == brute_bm25(queries, docs, 7)
    before = {f for f in postings.Files(spark, index.path).sizes() if "_versions" not in f}
    for step in range(3):
        batch = {i: text() for i in range(step * 20, step * 20 + 25)} | {500 + step: "own own own funds"}
        docs |= batch
        index.upsert(frame(batch))
        assert found() == brute_bm25(queries, docs, 7)
        assert index.figures()[0] == len(docs)
    assert before <= set(postings.Files(spark, index.path).sizes())  # an upsert leaves older segments' files alone
    index.merge()
    index.vacuum()
    assert found() == brute_bm25(queries, docs, 7)
    assert len([n for n in postings.Files(spark, index.path).names() if n.startswith("s-")]) == 1
    plan = index.of_terms(asked.select("query_id", F.explode(F.split("text", " ")).alias("term")))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "NestedLoop" not in plan


def test_postings_of_odd_documents(spark):
    asked = spark.createDataFrame([(0, "own funds")], "query_id long, text string")
    frame = lambda rows: postings.of_texts(spark.createDataFrame(rows, "node_id long, text string"))
    none = postings.Postings.create(frame([(1, ""), (2, None)]), folder())
    assert none.bm25(asked, 3).count() == 0 and none.figures() == (2, 0.0)
    none.upsert(frame([(2, "own funds"), (3, "own")]))
    assert rows_of(none.bm25(asked, 3), "node_id", "rank") == [(2, 1), (3, 2)]
    twice = postings.Postings.create(frame([(1, "own"), (1, "own own funds"), (2, "funds"), (None, "own")]), folder())
    assert twice.figures() == (2, 2.0) and {r["node_id"] for r in twice.bm25(asked, 3).collect()} == {1, 2}
    assert postings.Postings.create(frame([]), folder()).bm25(asked, 3).count() == 0


def test_sparse_weights(spark):
    docs = [(1, {3: 0.5, 7: 1.5}), (2, {7: 2.0}), (3, {}), (4, None), (5, {3: 0.0, 9: 1.0})]
    index = postings.Postings.create(postings.of_weights(spark.createDataFrame(docs, "node_id long, sparse map<int,float>")), folder())
    asked = spark.createDataFrame([(0, {3: 2.0, 7: 1.0}), (1, {9: 1.0, 3: None}), (2, {}), (3, None)], "query_id long, sparse map<int,float>")
    assert rows_of(index.dot(asked, 5), "query_id", "node_id", "score", "rank") == [(0, 1, 2.5, 1), (0, 2, 2.0, 2), (1, 5, 1.0, 1)]


TABLE = "key string, language string, chunk_type string, text string"


def test_bucket_table(spark):
    path = folder()
    rows = {f"k{i}": ("en" if i % 2 else "it", "ARTICLE" if i % 3 else "PARAGRAPH", f"t{i}") for i in range(60)}
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], TABLE)
    index_table.create(frame(rows), path, buckets=8)
    table = BucketTable(spark, path)
    held = lambda df: {r["key"]: (r["language"], r["chunk_type"], r["text"]) for r in df.collect()}
    assert held(index_table.scan(spark, path)) == rows
    first, before = index_table.scan(spark, path), table.files()
    batch = {"k3": ("it", "ARTICLE", "new"), "k999": ("en", "ARTICLE", "fresh")}
    index_table.upsert(spark, path, frame(batch))
    assert held(index_table.scan(spark, path)) == rows | batch
    assert held(first) == rows == held(table.scan(version=1))  # a reader of the version before still has it
    after = table.files()
    assert len(set(before) - set(after)) <= 2 * 4 and set(before) & set(after)  # two of eight buckets at most were written
    assert {r["key"] for r in index_table.scan(spark, path, language="it", chunk_type="ARTICLE").collect()} == {k for k, v in (rows | batch).items() if v[:2] == ("it", "ARTICLE")}
    assert "PartitionFilters: [isnotnull(language" in index_table.scan(spark, path, language="it")._jdf.queryExecution().toString()
    assert held(table.lookup(["k3", "nobody"])) == {"k3": batch["k3"]}
    version = table.version()
    table.upsert(frame(batch).limit(0))
    assert table.patch({"text": F.lit("new")}, F.col("key") == "k3") == (version, 0) and table.version() == version
    before = table.files()
    assert index_table.patch(spark, path, {"text": F.upper("text"), "language": F.lit("pl")}, F.col("key").isin("k3", "k999")) == 2
    assert held(table.scan()) == rows | {"k3": ("pl", "ARTICLE", "NEW"), "k999": ("pl", "ARTICLE", "FRESH")}
    assert set(before) & set(table.files())
    table.vacuum()
    assert held(table.scan()) == rows | {"k3": ("pl", "ARTICLE", "NEW"), "k999": ("pl", "ARTICLE", "FRESH")}
    with pytest.raises(Exception, match="without a key"):
        table.upsert(spark.createDataFrame([(None, "en", "ARTICLE", "x")], TABLE))
    with pytest.raises(ValueError):
        table.patch({"key": F.lit("x")})
    table.upsert(spark.createDataFrame([("k3", "pl", "ARTICLE", "a", 1), ("k3", "pl", "ARTICLE", "b", 2)], TABLE + ", extra int"))
    assert [(r["text"], r["extra"]) for r in table.lookup(["k3"]).collect()] == [("b", 2)]


def test_one_of_two_writers(spark):
    path = folder()
    table = BucketTable.create(spark.createDataFrame([("a", 1)], "key string, n int"), path, "key", 4)
    versions = Versions(spark, path)
    seen, manifest = versions.current()
    assert versions.switch(seen, manifest) == 2
    with pytest.raises(Conflict):
        versions.switch(seen, manifest)
    assert table.upsert(spark.createDataFrame([("a", 2)], "key string, n int")) == 3
    assert [r["n"] for r in table.scan().collect()] == [2]


def test_stream_into_buckets(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    index_table.create(spark.createDataFrame([("a", "en", "ARTICLE", "old"), ("z", "en", "ARTICLE", "z")], TABLE), base + "/index", buckets=4)
    for i, text in enumerate(("new", "newer")):
        spark.createDataFrame([("a", "en", "ARTICLE", text), (f"b{i}", "it", "ARTICLE", "x")], TABLE).write.parquet(f"{base}/in/{i}")
        ingest.upsert_stream(spark.readStream.schema(TABLE).parquet(base + "/in/*"), base + "/index", base + "/cp").awaitTermination(60)
    assert {(r["key"], r["text"]) for r in index_table.scan(spark, base + "/index").collect()} == {("a", "newer"), ("z", "z"), ("b0", "x"), ("b1", "x")}
