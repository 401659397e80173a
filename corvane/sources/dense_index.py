"""A stored index of vectors with exact cosine search: pivot cells, their radii, and blocks of vectors.

Each vector stands in the cell of the pivot with the least angle to it; a cell's
radius is its members' greatest angle to the pivot. No member of a cell can be
nearer to a query than the angle to the pivot less the radius. A query first reads
the cells with the best bounds until these hold k vectors, which gives it a bar,
and then only those cells whose bound reaches the bar.

Vectors are stored as unit vectors in blocks of BLOCK_ROWS at most, so that a cell
of any share of the rows is read by many tasks, and blocks are sorted by cell, so
that a search reads row groups of its cells only. Rows of a block have the same
values of the index's keys; a filter on these is a filter on blocks.

Queries are the small side: they come through the driver in pieces of MOST_SENT
bytes, each with its own passes. Vectors of other lengths than the index's, and
vectors without a direction (null, zero, or with null or non-finite components),
are never found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Files, shared_folder, stored

#: Pivots at most, rows of a block, bytes of queries that go to all tasks at once, and the room that rounding may take.
MOST_PIVOTS, BLOCK_ROWS, MOST_SENT, ROOM = 1024, 4096, 8 << 20, 2e-6
DIGITS = 6


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction and this length (any, if 0, and then the first row's), and their unit vectors."""
    rows = np.flatnonzero(np.asarray(pc.is_valid(column)))
    lists = column.take(pa.array(rows))
    values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan")), np.float64)
    size = np.asarray(pc.list_value_length(lists), np.int64)
    width = width or (int(size[0]) if len(size) else 0)
    edges, mine = np.concatenate([[0], np.cumsum(size)]), np.flatnonzero(size == width)
    matrix = np.stack([values[edges[i] : edges[i] + width] for i in mine]) if len(mine) else np.zeros((0, width))
    norm = np.sqrt((matrix * matrix).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[mine[good]], matrix[good] / norm[good, None]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


@dataclass
class DenseIndex:
    """An index at a path: ``blocks`` (keys, cell, ids, vectors) and ``cells`` (cell, pivot, radius, n)."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(nodes: DataFrame, path: str, keys: tuple[str, ...] = (), pivots: int | None = None) -> DenseIndex:
        """Index (node_id, vector, *keys) rows. By default there is a pivot for the root of the number of rows."""
        spark = nodes.sparkSession
        rows = nodes.select("node_id", "vector", *keys)
        most = min(MOST_PIVOTS, pivots or max(1, int(rows.count() ** 0.5)))
        first = rows.where("vector is not null").orderBy(F.xxhash64("node_id"), "node_id").limit(most).select("vector").toArrow().column("vector").combine_chunks()
        _, chosen = _units(first if isinstance(first, pa.Array) else pa.array([], first.type), 0)
        sent = spark.sparkContext.broadcast(chosen)
        key_type = nodes.schema["node_id"].dataType

        def place(batches):
            pivot = sent.value
            for batch in batches:
                at, units = _units(batch.column("vector"), pivot.shape[1]) if len(pivot) else (np.zeros(0, np.int64), np.zeros((0, 0)))
                angle = _angles(units, pivot) if len(pivot) else np.zeros((0, 1))
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node_id").take(pa.array(at)), *(batch.column(k).take(pa.array(at)) for k in keys), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(at)), cell]), pa.array([u.tobytes() for u in units], pa.binary())],
                    names=["node_id", *keys, "cell", "angle", "unit"],
                )

        kept = T.StructType([T.StructField("node_id", key_type), *(nodes.schema[k] for k in keys), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("unit", T.BinaryType())])
        rows.mapInArrow(place, kept).write.mode("overwrite").parquet(f"{path}/_placed")
        placed = spark.read.schema(kept).parquet(f"{path}/_placed")
        group = ["cell", *keys]
        cells = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        pivot_rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(chosen)], "cell int, pivot array<double>")
        pivot_rows.join(cells, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        # Cells are cut into as many blocks as their size asks for; ids are dealt to them by hash.
        sizes = placed.groupBy(*group).agg(F.count("*").alias("_n")).withColumnsRenamed({g: f"_{g}" for g in group})
        same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group))
        dealt = placed.join(F.broadcast(sizes) if not keys else sizes, same).withColumn("block", F.pmod(F.xxhash64("node_id"), F.ceil(F.col("_n") / BLOCK_ROWS)))
        packed = dealt.groupBy(*group, "block").agg(F.collect_list(F.struct("node_id", "unit")).alias("r"))
        packed.select(*group, F.col("r.node_id").alias("ids"), F.col("r.unit").alias("units")).repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/blocks")
        Files(spark, path).delete("_placed")
        return DenseIndex(spark, path)

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def _bounds(self, queries: np.ndarray, cells: list) -> np.ndarray:
        """(query, cell): the best score that a member can have."""
        pivots, radius = np.array([r["pivot"] for r in cells]), np.array([r["radius"] for r in cells])
        return np.cos(np.maximum(0.0, _angles(queries, pivots) - radius[None, :]))

    def _read(self, ids, units: np.ndarray, visits: dict[int, np.ndarray], k: int, where: Column | None, keep_self: bool, schema: T.StructType) -> DataFrame:
        """The k best rows of each visited block for each query that visits it."""
        width = units.shape[1]
        sent = self.spark.sparkContext.broadcast((ids, units, visits))
        blocks = self.blocks.where(F.col("cell").isin(sorted(visits)))
        blocks = blocks.where(where) if where is not None else blocks

        def run(batches):
            asked, matrix, to_visit = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    who = to_visit[batch.column("cell")[i].as_py()]
                    members = batch.column("ids").slice(i, 1).flatten()
                    theirs = np.frombuffer(b"".join(batch.column("units").slice(i, 1).flatten().to_pylist()), np.float64).reshape(-1, width)
                    score = np.round(matrix[who] @ theirs.T, DIGITS) + 0.0
                    if not keep_self:
                        own = pc.index_in(members, value_set=asked.take(pa.array(who)))
                        mine = np.flatnonzero(np.asarray(pc.is_valid(own)))
                        score[np.asarray(own.fill_null(0))[mine], mine] = -np.inf
                    # All that tie with the k-th stay: ids decide later.
                    bar = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(who), -np.inf)
                    row, col = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(who[row])), pa.array(who[row], pa.int32()), members.take(pa.array(col)), pa.array(score[row, col])], names=["query_id", "q", "node_id", "score"])

        found = blocks.select("cell", "ids", "units").mapInArrow(run, schema)
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "node_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, where: Column | None = None, keep_self: bool = False) -> tuple[DataFrame, DataFrame]:
        """(query_id, node_id, score, rank) of the k best nodes of (query_id, vector), and (query_id, cells, vectors) that were read for each.

        ``where`` is a condition on the index's keys. A node with the query's own
        id is left out unless ``keep_self``. Scores are rounded to DIGITS.
        """
        cells = self.cells.orderBy("cell").collect()
        count, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        pieces = max(1, -(-count * (width + 2) * 8 // MOST_SENT))
        keep_self = keep_self or queries.schema["query_id"].dataType != self.blocks.schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("node_id", self.blocks.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
        inner = T.StructType([schema["query_id"], T.StructField("q", T.IntegerType()), schema["node_id"], schema["score"]])
        hits, reads = [], []
        for piece in range(pieces if cells else 0):
            asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == piece).select("query_id", "vector").toArrow().combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in asked.columns]
            if not asked.num_rows:
                continue
            at, units = _units(columns[1], len(cells[0]["pivot"]))
            ids = columns[0].take(pa.array(at))
            if not len(units):
                continue
            found, read = self._piece(ids, units, cells, k, where, keep_self, inner)
            hits.append(found)
            reads.append(read)
        empty = self.spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
        together = lambda parts, none: reduce(DataFrame.unionByName, parts) if parts else none
        id_field = schema["query_id"]
        none = self.spark.createDataFrame([], T.StructType([id_field, T.StructField("cells", T.LongType()), T.StructField("vectors", T.LongType())]))
        return together(hits, empty), together(reads, none)

    def _piece(self, ids: pa.Array, units: np.ndarray, cells: list, k: int, where: Column | None, keep_self: bool, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
        bounds, sizes = self._bounds(units, cells), np.array([r["n"] for r in cells])
        order = np.argsort(-bounds, axis=1, kind="stable")
        # ``q`` numbers the piece's queries, whose ids may be of any type. The best cells until k vectors besides the query's own are there.
        held = np.cumsum(sizes[order], axis=1)
        need = np.minimum((held <= k).sum(axis=1) + 1, len(cells))
        first = np.zeros(bounds.shape, bool)
        for q, n in enumerate(need.tolist()):
            first[q, order[q, :n]] = True
        visit = lambda mask: {cells[c]["cell"]: np.flatnonzero(mask[:, c]) for c in np.flatnonzero(mask.any(axis=0)).tolist()}
        begun = stored(self._read(ids, units, visit(first), k, where, keep_self, schema), shared_folder(self.spark, "search"))
        bar = np.full(len(units), -np.inf)
        for r in begun.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar")).where("bar is not null").collect():
            bar[r["q"]] = r["bar"]
        rest = ~first & (bounds + ROOM >= bar[:, None])
        both = begun
        if rest.any():
            more = self._read(ids, units, visit(rest), k, where, keep_self, schema)
            w = Window.partitionBy("q").orderBy(F.col("score").desc(), "node_id")
            both = begun.unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        read = pa.table({"query_id": ids, "cells": pa.array((first | rest).sum(axis=1)), "vectors": pa.array(((first | rest) * sizes[None, :]).sum(axis=1))})
        return both.select("query_id", "node_id", "score", "rank"), self.spark.createDataFrame(read)
