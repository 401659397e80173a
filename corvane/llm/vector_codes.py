"""Product codes of vectors: codebooks by integer k-means, nearest entries by a kd-tree per codebook.

Vectors become integers and are cut into equal consecutive parts, each with a
codebook of its own. In each round the codebooks' kd-trees are broadcast (their
size is fixed by ENTRIES), every part finds its nearest entry by branch and
bound, and tasks add up integer sums and counts by entry, which one aggregation
joins; the driver gets a row for each codebook entry and nothing else.

The search goes down to the leaf where a point belongs, then over the whole
tree: a node is left out only where its box is farther than the best entry so
far. Boxes at the same distance are visited, and of entries at the same distance
the lowest index stays, so that ties are settled as a full scan settles them.

Defined results: vectors that are null, or hold null or non-finite components,
have no row. Rows without an id are coded, but don't begin a codebook; rows of
one id begin it in order of their components. Vectors of another length than
the first kept one's have no code and no error; a length that PARTS doesn't
divide gives parts as even as can be. Components of more than the root of
2**60 / length after scaling count as that, which keeps all errors in 64 bits.
Fewer vectors than ENTRIES make smaller codebooks; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf; components of a sum that one row carries; labels whose sums go to all tasks.
LEAF, SLOT, MOST_LABELS = 16, 16, 1 << 16
#: Shares that the rows of a label are dealt in where there are more labels.
SALTS = 64
_INTS = "vec_id long, label int, vector binary"


@dataclass
class Tree:
    """A codebook's kd-tree: the entries, and a node as its entries' box and two halves, or as a leaf's indexes."""

    entries: np.ndarray
    nodes: list[tuple]

    @staticmethod
    def of(entries: np.ndarray) -> Tree:
        nodes: list[tuple] = []

        def grow(which: np.ndarray) -> int:
            here = entries[which]
            low, high = here.min(axis=0, initial=2**62), here.max(axis=0, initial=-(2**62))
            at = len(nodes)
            nodes.append(())
            axis = int(np.argmax(high - low)) if len(low) else 0
            if len(which) <= LEAF or not len(low) or low[axis] == high[axis]:
                nodes[at] = (low, high, np.sort(which))
            else:
                order = which[np.argsort(here[:, axis], kind="stable")]
                half = len(order) // 2
                nodes[at] = (low, high, axis, int(entries[order[half], axis]), grow(order[:half]), grow(order[half:]))
            return at

        grow(np.arange(len(entries)))
        return Tree(entries, nodes)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to each point's nearest entry, the lowest index among equals."""
        width = points.shape[1]
        most = max(int(np.abs(points).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        whole = 4 * max(1, width) * most * most < 2**53  # then sums of products are exact in doubles, and faster
        points, entries = (points.astype(np.float64), self.entries.astype(np.float64)) if whole else (points, self.entries)
        best = np.full(len(points), np.inf if whole else np.iinfo(np.int64).max, points.dtype)
        found = np.full(len(points), len(entries), np.int64)
        squares = (points * points).sum(axis=1)

        def try_leaf(rows: np.ndarray, which: np.ndarray) -> None:
            if whole:
                away = squares[rows, None] - 2 * (points[rows] @ entries[which].T) + (entries[which] ** 2).sum(axis=1)
            else:
                away = np.stack([((points[rows] - entries[i]) ** 2).sum(axis=1) for i in which], axis=1)
            first = away.argmin(axis=1)  # indexes ascend within a leaf
            value, index = away[np.arange(len(rows)), first], which[first]
            better = (value < best[rows]) | ((value == best[rows]) & (index < found[rows]))
            best[rows[better]], found[rows[better]] = value[better], index[better]

        def go_home(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(self.nodes[node]) == 3:
                return try_leaf(rows, self.nodes[node][2])
            _, _, axis, cut, left, right = self.nodes[node]
            lower = points[rows, axis] < cut
            go_home(left, rows[lower])
            go_home(right, rows[~lower])

        def bounded(node: int, rows: np.ndarray) -> None:
            low, high, *rest = self.nodes[node]
            out = np.maximum(np.maximum(low - points[rows], points[rows] - high), 0)
            rows = rows[(out * out).sum(axis=1) <= best[rows]]
            if not len(rows):
                return
            if len(rest) == 1:
                return try_leaf(rows, rest[0])
            bounded(rest[2], rows)
            bounded(rest[3], rows)

        every = np.arange(len(points))
        go_home(0, every)
        bounded(0, every)
        return found, best.astype(np.int64)


def _cuts(width: int) -> list[tuple[int, int]]:
    return [(p * width // PARTS, (p + 1) * width // PARTS) for p in range(PARTS)]


def _integers(batches):
    """Vectors that take part, as floor(SCALE * x) in 64-bit integers."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("embedding")))
        lists = batch.column("embedding")
        values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
        width = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(width)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        rows = np.flatnonzero(bad[edges[1:]] == bad[edges[:-1]])
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(values * SCALE)
        bound = np.array([math.isqrt(2**60 // max(1, int(w))) for w in width], np.float64)
        most = np.repeat(bound, width)
        whole = np.nan_to_num(np.clip(scaled, -most, most)).astype("<i8")
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(rows)), batch.column("label").take(pa.array(rows)), pa.array([whole[edges[i] : edges[i + 1]].tobytes() for i in rows], pa.binary())],
            names=["vec_id", "label", "vector"],
        )


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the width, and their vectors."""
    column = batch.column("vector")
    rows = np.flatnonzero(np.asarray(pc.binary_length(column)) == 8 * width)
    return rows, np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), "<i8").reshape(len(rows), width)


def _sums(ints: DataFrame, trees, width: int) -> DataFrame:
    """(part, entry, slot, n, s0, ...): sums of the parts that are nearest to each entry, SLOT components a row."""
    cuts = _cuts(width)
    slots = -(-max(1, *(b - a for a, b in cuts)) // SLOT)
    names = [f"s{i}" for i in range(SLOT)]

    def run(batches):
        total = np.zeros((PARTS, ENTRIES, slots * SLOT), np.int64)
        count = np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            _, vectors = _matrix(batch, width)
            if not len(vectors):
                continue
            for p, (a, b) in enumerate(cuts):
                found, _ = trees.value[p].nearest(vectors[:, a:b])
                count[p] += np.bincount(found, minlength=ENTRIES)
                if b > a:
                    order = np.argsort(found, kind="stable")
                    starts = np.flatnonzero(np.diff(found[order], prepend=-1))
                    total[p, found[order][starts], : b - a] += np.add.reduceat(vectors[order, a:b], starts, axis=0)
        part, entry = np.nonzero(count)
        part, entry, slot = np.repeat(part, slots), np.repeat(entry, slots), np.tile(np.arange(slots), len(part))
        pieces = total.reshape(PARTS, ENTRIES, slots, SLOT)[part, entry, slot]
        columns = [pa.array(x, pa.int32()) for x in (part, entry, slot)] + [pa.array(count[part, entry])] + [pa.array(np.ascontiguousarray(pieces[:, i])) for i in range(SLOT)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "slot", "n", *names])

    each = in_arrow(ints, run, "part int, entry int, slot int, n long, " + ", ".join(f"{n} long" for n in names))
    return each.groupBy("part", "entry", "slot").agg(F.sum("n").alias("n"), *(F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names))


def fit(spark: SparkSession, ints: DataFrame) -> tuple[list[np.ndarray], int]:
    """The codebooks after ROUNDS rounds, and the vectors' length."""
    first = ints.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "vector").limit(ENTRIES).collect()
    if not first:
        return [], 0
    width = len(first[0]["vector"]) // 8
    start = np.array([np.frombuffer(r["vector"], "<i8") for r in first if len(r["vector"]) == 8 * width]).reshape(-1, width)
    books = [start[:, a:b].copy() for a, b in _cuts(width)]
    for _ in range(ROUNDS):
        trees = spark.sparkContext.broadcast([Tree.of(b) for b in books])
        for r in _sums(ints, trees, width).collect():
            book, at = books[r["part"]], r["slot"] * SLOT
            for i in range(min(SLOT, book.shape[1] - at)):
                book[r["entry"], at + i] = int(r[f"s{i}"]) // r["n"]
        trees.unpersist()
    return books, width


def encode(spark: SparkSession, ints: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    trees = spark.sparkContext.broadcast([Tree.of(b) for b in books])
    cuts = _cuts(width)

    def run(batches):
        for batch in batches:
            rows, vectors = _matrix(batch, width) if trees.value else ([], None)
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            if len(rows):
                found = [t.nearest(vectors[:, a:b]) for t, (a, b) in zip(trees.value, cuts, strict=True)]
                digits = np.stack([f for f, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                total = sum(d for _, d in found)
                for k, i in enumerate(rows.tolist()):
                    code[i], error[i] = digits[2 * PARTS * k : 2 * PARTS * (k + 1)], int(total[k])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return in_arrow(ints, run, "vec_id long, label int, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Each row with the errors of its label summed; a label may hold any share of the rows."""
    most, total = F.lit(2**63 - 1).cast("decimal(38,0)"), F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.when(total <= most, total).when(total > most, most).cast("long").alias("label_error"))
    if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        other, on = F.broadcast(sums.withColumnRenamed("label", "_label")), F.col("label").eqNullSafe(F.col("_label"))
        return coded.join(other, on, "left").drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    copies = sums.withColumnRenamed("label", "_label").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_s")), "left").drop("_label", "_s", "_salt")


def sha_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def codes(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector that takes part."""
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    ints = in_arrow(named, _integers, _INTS)
    books, width = fit(spark, ints)
    coded = Scratch(spark, "codes").cut(encode(spark, ints, books, width), "coded")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(sha_of(books)).alias("codebooks_sha256"))


def oracle() -> str:
    dot = "list_dot_product"
    text = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM k, range({PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < {ENTRIES})"""
    for i in range(ROUNDS + 1):
        text += f""",
a{i} AS MATERIALIZED (SELECT vec_id, p.part, min(({dot}(p.v, p.v) - 2 * {dot}(p.v, b.v) + {dot}(b.v, b.v))::BIGINT * {ENTRIES} + entry) AS m FROM p JOIN b{i} b ON p.part = b.part GROUP BY ALL)"""
        if i < ROUNDS:
            text += f""",
s{i} AS (SELECT part, m % {ENTRIES} AS entry, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS pos FROM a{i} JOIN p USING (vec_id, part)),
f{i} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS c FROM s{i} GROUP BY ALL),
n{i} AS (SELECT part, entry, list(((s - ((s % c) + c) % c) // c)::DOUBLE ORDER BY pos) AS v FROM f{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN n{i} n USING (part, entry))"""
    return text + f""",
h AS (SELECT part, entry, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS pos FROM b{ROUNDS}),
sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM h),
o AS (SELECT vec_id, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
l AS (SELECT vec_id, code, error, label FROM o JOIN k USING (vec_id))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM l, sha
"""
