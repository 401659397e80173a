"""Exact top-k search by MaxScore over shards of postings.

A vector's components are the weights of its terms; a shard holds, for each
term, the weights of all its rows, and their least and greatest value. For a
query, terms are ordered by how far they can move a score. The first ones are
essential: rows at their least on all of these cannot compete even with the
greatest values elsewhere. Essential postings are traversed for the whole
shard; the others are probed only for rows that stay competitive, in steps,
until their scores are whole. Shards' best rows are merged.

Queries are a stated set; a block of them is sent to TOGETHER shards at a time,
and each shard travels once.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, nor do rows without ``vec_id``; vectors of other lengths than the
query's are no candidates; ties go to the smaller id; a query never finds
itself, nor another row with its id; scores of any size are ranked exactly, and
those beyond 64 bits are given as the nearest long; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, groups, in_arrow

#: Rows of a shard, queries of a block, and terms probed at once; shards that a block of queries is sent to together.
SHARD_ROWS, BLOCK_QUERIES, PROBE, TOGETHER = 2048, 256, 8, 16
SCALE = 256
#: Sums of products stay exact in doubles below the first of these, in 64-bit integers below the second, and in Python's from there on.
EXACT, LONG = 2.0**53, 2.0**62
_VECTORS = "vec_id long, width int, vector binary"
_PACKED = "block long, width int, ids binary, vectors binary"


def _whole(batches):
    """Vectors that take part, as floor(SCALE * x)."""
    for batch in batches:
        lists = batch.column("embedding")
        ids = batch.column("vec_id")
        ok = pc.and_(pc.is_valid(lists), pc.is_valid(ids))
        lists, ids = lists.filter(ok), ids.filter(ok)
        values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
        width = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(width)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = bad[edges[1:]] == bad[edges[:-1]]
        floored = np.floor(values * SCALE)
        rows = np.flatnonzero(good & (width > 0))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), pa.array(width[rows], pa.int32()), pa.array([floored[edges[i] : edges[i + 1]].tobytes() for i in rows], pa.binary())],
            names=["vec_id", "width", "vector"],
        )


def _pack(batches):
    for group in groups(batches, ["block", "width"]):
        yield pa.RecordBatch.from_arrays(
            [
                group.column("block").slice(0, 1).combine_chunks(),
                group.column("width").slice(0, 1).combine_chunks(),
                pa.array([np.asarray(group.column("vec_id"), dtype="<i8").tobytes()], pa.binary()),
                pa.array([b"".join(group.column("vector").to_pylist())], pa.binary()),
            ],
            names=["block", "width", "ids", "vectors"],
        )


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows in blocks of about ``size``, one row each."""
    blocks = max(1, -(-rows.count() // size))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return keyed.repartition("block", "width").sortWithinPartitions("block", "width", "vec_id").transform(in_arrow, _pack, _PACKED)


def search_shard(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, known: dict[int, float]):
    """The k best rows of a shard for each query that may be among its best of all.

    ``known`` has, and gets, the k-th best score that each query is sure of.
    """
    postings = np.ascontiguousarray(rows.T)
    low, high = postings.min(axis=1), postings.max(axis=1)
    most_of_all = float(np.abs(queries).max(initial=0)) * float(np.abs(postings).max(initial=0)) * len(low)
    if most_of_all >= EXACT:
        whole = np.int64 if most_of_all < LONG else object
        as_whole = (lambda x: x.astype(np.int64)) if whole is np.int64 else (lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape))
        queries, rows, postings, low, high = (as_whole(x) for x in (queries, rows, postings, low, high))
    out = []
    for q, qid in zip(queries, query_ids.tolist(), strict=True):
        most, least = np.maximum(q * low, q * high), np.minimum(q * low, q * high)
        order = np.argsort(-(most - least), kind="stable")
        w, most, least = q[order], most[order], least[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], most[:1] * 0)
        bar = known.get(qid, -np.inf)
        if bar == -np.inf:
            # The first rows' whole scores give a bar to begin with.
            first = rows[:64] @ q
            first = first[ids[:64] != qid]
            if len(first) >= k:
                bar = np.sort(first)[len(first) - k]
        # Essential: the shortest run of terms without which no row can reach the bar.
        lost = np.append(least[:1] * 0, np.cumsum(least)) + rest < bar
        n = int(np.argmax(lost)) if lost.any() else len(w)
        n = max(1, n)
        score = w[:n] @ postings[order[:n]]
        alive = np.flatnonzero((score + rest[n] >= bar) & (ids != qid))
        score = score[alive]
        while n < len(w) and len(alive):
            terms = order[n : n + PROBE]
            score = score + w[n : n + PROBE] @ postings[terms[:, None], alive[None, :]]
            n += PROBE
            stays = score + rest[min(n, len(w))] >= bar
            alive, score = alive[stays], score[stays]
        if len(alive):
            by_id = np.argsort(ids[alive], kind="stable")
            best = by_id[np.argsort(-score[by_id], kind="stable")][:k]
            if len(best) == k:
                known[qid] = max(bar, score[best[-1]])
            far = np.iinfo(np.int64)
            out.append((np.full(len(best), qid), ids[alive[best]], np.array([min(max(int(x), far.min), far.max) for x in score[best]], np.int64)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows."""
    scratch = Scratch(spark, "maxscore")
    whole = scratch.cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").transform(in_arrow, _whole, _VECTORS), "whole")
    shards = _packed(whole, SHARD_ROWS)
    asked = scratch.cut(_packed(whole.where(is_query), BLOCK_QUERIES), "queries").select("width", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    together = lambda block: F.floor(block / TOGETHER)
    last = max(1, -(-whole.count() // SHARD_ROWS)) - 1
    each = shards.select(together(F.col("block")).alias("meet"), "width", "ids", "vectors")
    asked = asked.withColumn("meet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last // TOGETHER).cast("long"))))

    def run(batches):
        known: dict[int, float] = {}
        for batch in batches:
            for r in batch.to_pylist():
                as_rows = lambda raw: np.frombuffer(raw, np.float64).reshape(-1, r["width"])  # noqa: B023, E731
                found = search_shard(as_rows(r["q_vectors"]), np.frombuffer(r["q_ids"], "<i8"), as_rows(r["vectors"]), np.frombuffer(r["ids"], "<i8"), k, known)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    found = each.join(asked, ["meet", "width"]).transform(in_arrow, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    return f"""
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
