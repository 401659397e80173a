"""A stored inverted index: postings in buckets of terms, in segments that are added and merged.

A segment holds postings (term, node_id, value, length) under a folder for each
bucket of terms, sorted by term within, and its documents (node_id, length). An
upsert writes a new segment with the batch's documents, and notes which older
segments' rows of these it replaces; nothing else is touched. A search prunes to
its terms' buckets, and leaves replaced rows out by an equi-join with the notes. A
merge writes the live rows of all segments as one, bucket by bucket. Segments, the
number of live documents and their total length stand in a manifest that is
switched in one step, so that readers have the index before or after.

Both kinds of sparse retrieval are here: BM25, where ``value`` is a term's count in
a text, and the product of learned term weights, where it is a weight.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .workspace import Files, Versions, stored

#: Folders that a segment's terms are dealt to; asked terms that are sent to all tasks; documents for each file of a bucket.
BUCKETS, MOST_ASKED, FILE_DOCS = 16, 1 << 18, 20_000
ROW_GROUP = 16 << 20
#: Documents that are scored at once, cells of their scores, and pairs of a query and a term that are sent for it.
SCORED_DOCS, MOST_CELLS, MOST_PAIRS = 2_000, 1 << 22, 1 << 21


def of_texts(nodes: DataFrame) -> DataFrame:
    """(node_id, length, terms) of (node_id, text): counts of words; a text is handled within its row."""
    words = nodes.select("node_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("w"))
    # A row's words sorted, then runs of equal ones: no shuffle and no quadratic count.
    sorted_ = words.select("node_id", F.size("w").cast("long").alias("length"), F.sort_array("w").alias("w"))
    edges = F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: (i == 0) | (i == F.size("w")) | (F.get("w", i) != F.get("w", i - 1)))
    cut = sorted_.withColumn("e", F.when(F.size("w") > 0, edges))
    runs = F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda j: F.struct(F.get("w", F.get("e", j)).alias("term"), (F.get("e", j + 1) - F.get("e", j)).cast("double").alias("value")))
    return cut.select("node_id", "length", F.when(F.size("e") > 1, runs).alias("terms"))


def of_weights(nodes: DataFrame) -> DataFrame:
    """(node_id, length, terms) of (node_id, sparse), a map of terms to weights; weights that are null or 0 are none."""
    entries = F.filter(F.map_entries("sparse"), lambda e: e["value"].isNotNull() & (e["value"] != 0))
    terms = F.transform(entries, lambda e: F.struct(e["key"].cast("string").alias("term"), e["value"].cast("double").alias("value")))
    return nodes.select("node_id", F.coalesce(F.size(entries), F.lit(0)).cast("long").alias("length"), terms.alias("terms"))


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _one_each(docs: DataFrame) -> DataFrame:
    """One row of each id, the longest; only rows of ids that stand more than once are shuffled with their terms."""
    repeated = docs.groupBy("node_id").agg(F.count("*").alias("c")).where("c > 1").select("node_id")
    if repeated.isEmpty():
        return docs
    best = docs.join(repeated, "node_id", "left_semi").groupBy("node_id").agg(F.max(F.struct("length", "terms")).alias("d"))
    return docs.join(repeated, "node_id", "left_anti").unionByName(best.select("node_id", "d.length", "d.terms"))


def _write_postings(rows: DataFrame, documents: int, path: str) -> None:
    """By bucket and a hash of the document: a term of any share of the postings is written by many tasks."""
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("node_id"), F.lit(1 + documents // FILE_DOCS)))
    # Small row groups: less is held while they are written, and a term's are few.
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(path)


@dataclass
class Postings:
    """An index at a path."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(docs: DataFrame, path: str) -> Postings:
        """A new index of (node_id, length, terms) rows; an index that is there is replaced."""
        index = Postings(docs.sparkSession, path)
        seen, _ = Versions(index.spark, path).current()
        name, n, length = index._segment(docs)
        Versions(index.spark, path).switch(seen, {"segments": [name], "gone": [], "n": n, "length": length})
        return index

    def _segment(self, docs: DataFrame) -> tuple[str, int, int]:
        """Write a segment; its name, documents and their total length. Of rows with one id the longest counts."""
        name = f"s-{uuid.uuid4().hex}"
        base = f"{self.path}/{name}"
        # Written once, as the rows are read several times below, and gone with the segment's end.
        once = _one_each(stored(docs.where("node_id is not null").select("node_id", "length", "terms"), f"{base}/_in"))
        once.select("node_id", "length").write.mode("overwrite").parquet(f"{base}/docs")
        each = once.select("node_id", "length", F.explode("terms").alias("t")).select("t.term", "node_id", "t.value", "length").withColumn("bucket", _bucket())
        n, length = once.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        _write_postings(each, n, f"{base}/postings")
        self._write_terms(name)
        Files(self.spark, base).delete("_in")
        return name, n, length

    def _has_postings(self, segment: str) -> bool:
        return any(n.startswith("bucket=") for n in Files(self.spark, f"{self.path}/{segment}/postings").names())

    def _write_terms(self, segment: str) -> None:
        """A segment's document frequencies, beside its postings."""
        if self._has_postings(segment):
            rows = self.spark.read.parquet(f"{self.path}/{segment}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{segment}/terms")

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """(term, df) of the asked terms (term): from the segments' own counts as long as no row was replaced, else from live postings."""
        _, manifest = Versions(self.spark, self.path).current()
        if manifest["gone"]:
            return self.of_terms(asked).groupBy("term").agg(F.count("*").alias("df"))
        counted = self._all(manifest, "terms").join(_sent(asked.withColumn("bucket", _bucket())), ["bucket", "term"])
        return counted.groupBy("term").agg(F.sum("df").alias("df"))

    def _read(self, segment: str, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment}/{what}").withColumn("segment", F.lit(segment))

    def _all(self, manifest: dict, what: str) -> DataFrame:
        """Live rows of all segments."""
        rows = [self._read(s, what) for s in manifest["segments"] if what == "docs" or self._has_postings(s)]
        if not rows:  # documents without a term have no postings
            docs = self._read(manifest["segments"][0], "docs").limit(0)
            columns = {"term": F.lit(""), "bucket": F.lit(0)} | ({"df": F.lit(0).cast("long")} if what == "terms" else {"value": F.lit(0.0), "length": F.lit(0).cast("long")})
            return docs.select("segment", "node_id", *(v.alias(c) for c, v in columns.items()))
        both = reduce(DataFrame.unionByName, rows)
        if not manifest["gone"]:
            return both
        gone = self.spark.read.parquet(*(f"{self.path}/{g}" for g in manifest["gone"]))
        return both.join(gone, ["segment", "node_id"], "left_anti")

    def upsert(self, docs: DataFrame) -> int:
        """Add documents, in the place of those with their ids; the new version. Older segments keep their files."""
        versions = Versions(self.spark, self.path)
        seen, manifest = versions.current()
        name, n, length = self._segment(docs)
        fresh = self.spark.read.parquet(f"{self.path}/{name}/docs").select("node_id")
        replaced = self._all(manifest, "docs").join(fresh, "node_id", "left_semi")
        gone = stored(replaced.select("segment", "node_id", "length"), f"{self.path}/{name}/gone")
        out, less = gone.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        gone_now = manifest["gone"] + ([f"{name}/gone"] if out else [])
        return versions.switch(seen, {"segments": [*manifest["segments"], name], "gone": gone_now, "n": manifest["n"] - out + n, "length": manifest["length"] - less + length})

    def merge(self) -> int:
        """All live rows as one segment; older versions' files stay until ``vacuum``."""
        versions = Versions(self.spark, self.path)
        seen, manifest = versions.current()
        if len(manifest["segments"]) < 2:
            return seen
        name = f"s-{uuid.uuid4().hex}"
        self._all(manifest, "docs").select("node_id", "length").write.parquet(f"{self.path}/{name}/docs")
        live = self._all(manifest, "postings").drop("segment")
        _write_postings(live, manifest["n"], f"{self.path}/{name}/postings")
        self._write_terms(name)
        return versions.switch(seen, {**manifest, "segments": [name], "gone": []})

    def vacuum(self) -> None:
        """Delete segments that the current version doesn't name; nobody may be reading an older one."""
        _, manifest = Versions(self.spark, self.path).current()
        files = Files(self.spark, self.path)
        # A segment that is merged away still holds no notes in use: merging empties them.
        used = set(manifest["segments"]) | {g.split("/")[0] for g in manifest["gone"]}
        for name in files.names():
            if name.startswith("s-") and name not in used:
                files.delete(name)

    def figures(self) -> tuple[int, float]:
        """Live documents, and their mean length."""
        _, m = Versions(self.spark, self.path).current()
        return m["n"], m["length"] / m["n"] if m["n"] else 0.0

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """Live postings of the asked terms, with the rows that ask for them: only these terms' buckets are read."""
        _, manifest = Versions(self.spark, self.path).current()
        asked = asked.withColumn("bucket", _bucket())
        buckets = sorted(r[0] for r in asked.select("bucket").distinct().collect())
        live = self._all(manifest, "postings").where(F.col("bucket").isin(buckets))
        return live.join(_sent(asked), ["bucket", "term"])

    def bm25(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, keep: Callable[[DataFrame], DataFrame] | None = None, among: DataFrame | None = None) -> DataFrame:
        """(query_id, node_id, score, rank) of the k best nodes of (query_id, text); of those of ``among`` (node_id), or that ``keep`` leaves of all with a score, if given.

        ``keep`` is for rules that hang on the query: it gets a row for each query and node that share a term.
        """
        n, mean = self.figures()
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        df = self.frequencies(asked.select("term").distinct())
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("value") * (k1 + 1) / (F.col("value") + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0)))
        if keep is None:
            # A posting's weight is every query's that asks for its term.
            return self._scored(asked.withColumn("w", F.lit(1.0)), df, weight, n, k, 6, among)
        # The asked terms get their frequency first, so that postings meet one small side.
        met = self.of_terms(asked.join(df, "term"))
        met = met if among is None else met.join(among.select("node_id").distinct(), "node_id", "left_semi")
        return _best(keep(met.groupBy("query_id", "node_id").agg(F.round(F.sum(weight), 6).alias("score"))), k)

    def dot(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, node_id, score, rank) of the k nodes with the greatest products with (query_id, sparse)."""
        entries = queries.select("query_id", F.explode("sparse").alias("term", "weight"))
        asked = entries.where("weight is not null and weight <> 0").select("query_id", F.col("term").cast("string").alias("term"), F.col("weight").cast("double").alias("weight"))
        return self._scored(asked.withColumnRenamed("weight", "w"), None, F.col("value"), self.figures()[0], k, 8)

    def _scored(self, asked: DataFrame, df: DataFrame | None, value: Column, documents: int, k: int, places: int, among: DataFrame | None = None) -> DataFrame:
        """The k best nodes of each query of ``asked`` (query_id, term, w) by the sum of w * ``value`` over its terms.

        Postings of asked terms, each once however many queries ask for its term,
        are dealt by document; a group of documents is scored against all queries,
        and gives no more than k rows for each. What is shuffled grows with the
        documents and with the queries, but not with their product.
        """
        only = lambda met: met if among is None else met.join(among.select("node_id").distinct(), "node_id", "left_semi")
        terms = asked.select("term").distinct() if df is None else df
        pairs = asked.groupBy("query_id", "term").agg(F.sum("w").alias("w"))
        many, nameless = pairs.agg(F.count("*"), F.count_if(F.col("query_id").isNull())).first()
        if many > MOST_PAIRS or nameless:
            met = only(self.of_terms(pairs if df is None else pairs.join(df, "term")))
            return _best(met.groupBy("query_id", "node_id").agg(F.round(F.sum(F.col("w") * value), places).alias("score")), k)
        sent = pairs.toPandas()
        names, tids = np.unique(sent["term"].to_numpy(dtype=object).astype(str), return_inverse=True)
        ids, queries = np.unique(sent["query_id"].to_numpy(), return_inverse=True)
        numbers = self.spark.createDataFrame(pd.DataFrame({"term": names, "tid": np.arange(len(names), dtype=np.int32)}), "term string, tid int")
        met = only(self.of_terms(terms.join(numbers, "term")))
        groups = 1 + documents // SCORED_DOCS
        rows = met.select("node_id", "tid", value.alias("v"), F.pmod(F.xxhash64("node_id"), F.lit(groups)).alias("g"))
        held = self.spark.sparkContext.broadcast((ids, _blocks(tids, queries, sent["w"].to_numpy(dtype=float), len(ids))))
        types = asked.schema["query_id"].dataType.simpleString(), rows.schema["node_id"].dataType.simpleString()

        def best(part: pd.DataFrame) -> pd.DataFrame:
            asking, blocks = held.value
            return _group_best(part, asking, blocks, k, places)

        found = rows.groupBy("g").applyInPandas(best, f"query_id {types[0]}, node_id {types[1]}, score double")
        return _best(found, k)


def _blocks(tids: np.ndarray, queries: np.ndarray, weights: np.ndarray, n: int) -> list[tuple]:
    """(first query, queries, {term: (its queries, their weights)}) for each block of queries whose scores are held at once."""
    size, out = max(1, MOST_CELLS // (2 * SCORED_DOCS)), []
    for lo in range(0, n, size):
        here = np.flatnonzero((queries >= lo) & (queries < lo + size))
        here = here[np.argsort(tids[here], kind="stable")]
        own, starts = np.unique(tids[here], return_index=True)
        of = {int(t): (queries[i] - lo, weights[i]) for t, i in zip(own, np.split(here, starts[1:]))}
        out.append((lo, min(size, n - lo), of))
    return out


def _group_best(part: pd.DataFrame, ids: np.ndarray, blocks: list[tuple], k: int, places: int) -> pd.DataFrame:
    """(query_id, node_id, score): each query's k best of one group's nodes, equal scores by id; sums are made term by term, so that equal texts score alike."""
    part = part.sort_values("tid", kind="stable")
    nodes, at = np.unique(part["node_id"].to_numpy(), return_inverse=True)
    tids, values = part["tid"].to_numpy(), part["v"].to_numpy(dtype=float)
    own, starts = np.unique(tids, return_index=True)
    postings = list(zip(own.tolist(), np.split(at, starts[1:]), np.split(values, starts[1:])))
    found = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
    for lo, size, of in blocks:
        scores, met = np.zeros((size, len(nodes))), np.zeros((size, len(nodes)), bool)
        for term, docs, v in postings:
            if term in of:
                asking, w = of[term]
                cells = np.ix_(asking, docs)
                scores[cells] += w[:, None] * v[None, :]
                met[cells] = True
        scaled = np.abs(scores) * 10.0**places
        scores = np.copysign(np.floor(scaled + 0.5) / 10.0**places, scores) + 0.0
        scores[~met] = -np.inf
        if len(nodes) > k:
            order = np.where(np.isnan(scores), np.inf, scores)
            least = np.partition(order, len(nodes) - k, axis=1)[:, len(nodes) - k, None]
            above, equal = order > least, (order == least) & met
            met &= above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        q, d = np.nonzero(met)
        for to, x in zip(found, (q + lo, d, scores[q, d])):
            to.append(x)
    q, d, s = (np.concatenate(x) for x in found)
    return pd.DataFrame({"query_id": ids[q], "node_id": nodes[d], "score": s})


def _sent(asked: DataFrame) -> DataFrame:
    """To all tasks, if these are few rows."""
    return F.broadcast(asked) if asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED else asked


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
