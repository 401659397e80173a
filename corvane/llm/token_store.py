"""Token-id files: ORC stripes in ascending document order.

Ids are integers in ORC's run-length encoding; each stripe has row indexes and
a Bloom filter on ``doc_id``, so a reader takes stripes in parallel and skips
those that can't hold a document it looks for.

Defined results: a null or empty text gives the end id alone; a null ``doc_id``
comes first; rows that share a ``doc_id`` follow one another in text order; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, in_arrow, slices

FILE_SCHEMA = "doc_id long, ids array<int>, n_tokens int, part int, part_start long"
#: One (part, base) pair of 16 bytes is sent to all tasks for each written file, up to so many; more are joined.
MOST_SENT = 1_000_000


def write_token_orc(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1) -> None:
    spark, vocabulary = docs.sparkSession, vocabulary or tokens.default_vocabulary()

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", tokens.SLICE_BYTES):
                ids, starts = tokens.encode_column(piece.column("text"), vocabulary, end_id)
                n = np.diff(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(n, pa.int32()),
                        pa.array(np.full(len(n), part), pa.int32()),
                        pa.array(at + starts[:-1], pa.int64()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "part", "part_start"],
                )
                at += int(starts[-1])

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .transform(in_arrow, encode, FILE_SCHEMA, tokens.KEPT)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "1000")
        .orc(path)
    )
    # One row for each file: a running sum over them is one small task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = spark.read.schema(FILE_SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.orc(_bases(path))


def _bases(path: str) -> str:
    """Where the ids before each file are counted: beside the files, so that looking up a document reads no others."""
    return path.rstrip("/") + ".bases"


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); start counts all ids of the documents before."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    bases = spark.read.schema("part int, base long").orc(_bases(path))
    offsets = F.broadcast(bases) if bases.limit(MOST_SENT + 1).count() <= MOST_SENT else bases
    return files.join(offsets, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; stripes and row groups that can't hold them are skipped."""
    return read_token_orc(spark, path).where(F.col("doc_id").isin(doc_ids))


def _crc(batches):
    for batch in batches:
        lists = batch.column("ids")
        values = np.asarray(lists.values, dtype="<u4")
        raw, ends = memoryview(values.tobytes()), np.asarray(lists.offsets, dtype=np.int64) * 4
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the files to the shared folder, read them back, and sum each document's ids."""
    path = Scratch(spark, "token-orc").path("files")
    write_token_orc(docs, path)
    return read_token_orc(spark, path).transform(in_arrow, _crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
