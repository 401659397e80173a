"""Toxicity by a linear classifier on character n-grams scaled by log-count ratios.

A text's features are the character n-grams (of lower-cased UTF-8, white space
as blanks, one more before and after) that occur in it at all, hashed into ``2**BITS`` bins. Naive Bayes
gives each bin the log ratio of its smoothed shares in toxic and other texts;
a logistic regression on the features scaled by these ratios gives the weights.

The model is fitted on a bounded sample: at most ``SAMPLE_PER_CLASS`` labelled
texts of either class, whole, those with the smallest hashes of their ids. Only
counts by bin and the chosen features of each come to the driver, so nothing
there grows with the texts' lengths. Scoring reads every text whole, with a weight
table of fixed size, and shuffles nothing.

Defined results: null and empty texts get the score of the intercept alone;
without labelled texts of both classes all scores are the share of toxic
labels (0 without any); repeated rows are scored each on its own, and where rows share an id with
different texts the least text is learnt from; a column
named as an output is replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Prefix, Scratch, in_arrow, slices, utf8

ORDERS = (4, 5, 6)
BITS = 18
#: Bytes whose n-grams are hashed at once.
SEGMENT = 1 << 18
#: Labelled texts of each class that a model is fitted on at most.
SAMPLE_PER_CLASS = 2000
#: Tasks that count the sample.
FIT_TASKS = 8
#: Bins that keep a weight at most, and the least z score of the difference in shares.
MOST_FEATURES, LEAST_Z = 2048, 3.5


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


def _hits(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) for each bin that occurs in a text, once; only bins marked in ``wanted``."""
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    data, offsets = utf8(pc.binary_join_element_wise(blank, text, blank, none))
    data = np.where((data >= 9) & (data <= 13), np.uint8(32), data)
    keys, most = [], max(ORDERS)
    for a in range(0, len(data), SEGMENT):
        # A segment's n-grams may end beyond it; those over a text's end don't count.
        b = min(len(data), a + SEGMENT + most - 1)
        prefix = Prefix(data[a:b])
        i, j = np.searchsorted(offsets, (a, b), side="right")
        row = np.repeat(np.arange(i - 1, min(j, len(offsets) - 1)), np.diff([a, *offsets[i : min(j, len(offsets) - 1)], b]))
        for k in ORDERS:
            n = min(SEGMENT, b - a - k + 1)
            if n <= 0:
                continue
            bins = ((prefix.every(k)[:n] + U64(k)) >> U64(64 - BITS)).astype(np.int64)
            good = row[:n] == row[k - 1 : n + k - 1]
            if wanted is not None:
                good &= wanted[bins]
            keys.append(np.unique((row[:n][good] << BITS) | bins[good]))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the texts to learn from: none whose crc32(doc_id) is divisible by 5."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    # At most twice SAMPLE_PER_CLASS rows of two numbers go out to the scan of the texts.
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _counted(batches):
    """Texts of either class, and how many of them hold each bin: one row a task."""
    n, counts = [0, 0], np.zeros((2, 1 << BITS), "<i4")
    for batch in batches:
        for part in slices(batch):
            row, b = _hits(part.column("text"))
            toxic = np.asarray(part.column("toxic")) == 1
            for k in (0, 1):
                counts[k] += np.bincount(b[toxic[row] == bool(k)], minlength=1 << BITS).astype("<i4")
                n[k] += int((toxic == bool(k)).sum())
    if sum(n):
        raw = [pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in counts]
        yield pa.RecordBatch.from_arrays([pa.array([n[1]]), pa.array([n[0]]), pa.array([raw[1]], pa.binary()), pa.array([raw[0]], pa.binary())], names=["n1", "n0", "pos", "neg"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    share = {r["toxic"]: r["n"] for r in labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("toxic").agg(F.count("*").alias("n")).where(F.col("toxic").isin(0, 1)).collect()}
    # A few thousand texts: a handful of tasks, whose counts by bin are of fixed size.
    sample = Scratch(docs.sparkSession, "toxicity").cut(labelled_sample(docs, labels).repartition(FIT_TASKS, "doc_id"), "sample")
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    n1 = n0 = 0
    for row in sample.transform(in_arrow, _counted, "n1 long, n0 long, pos binary, neg binary").collect():  # FIT_TASKS rows
        n1, n0 = n1 + row["n1"], n0 + row["n0"]
        for into, raw in ((pos, row["pos"]), (neg, row["neg"])):
            into += np.frombuffer(pa.decompress(bytes(raw), 4 << BITS, codec="zstd", asbytes=True), "<i4")
    empty = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        rate = share.get(1, 0) / max(1, sum(share.values()))
        return Model(empty, math.log(rate / (1 - rate)) if 0 < rate < 1 else (40.0 if rate else -40.0))
    ratio = np.log((pos + 1) / (pos + 1).sum()) - np.log((neg + 1) / (neg + 1).sum())
    mean = (pos + neg + 1) / (n1 + n0 + 2)
    z = np.abs(pos / n1 - neg / n0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    z[pos + neg < 3] = 0
    chosen = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    chosen = np.sort(chosen[z[chosen] >= LEAST_Z])
    place, wanted = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
    place[chosen], wanted[chosen] = np.arange(len(chosen)), True

    def features(batches):
        """Each text's chosen features as bits."""
        for batch in batches:
            for part in slices(batch):
                row, b = _hits(part.column("text"), wanted)
                has = np.zeros((part.num_rows, len(chosen)), bool)
                has[row, place[b]] = True
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([x.tobytes() for x in np.packbits(has, axis=1)], pa.binary())], names=["doc_id", "toxic", "bits"])

    # At most twice SAMPLE_PER_CLASS rows of MOST_FEATURES bits; ids set the order, so that sums come out alike.
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text").transform(in_arrow, features, "doc_id long, toxic int, bits binary").toArrow().sort_by("doc_id")
    y = np.asarray(rows.column("toxic").to_numpy(), dtype=np.float64)
    packed = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(y), -1)
    x = np.unpackbits(packed, axis=1, count=len(chosen)).astype(np.float32)
    x *= ratio[chosen].astype(np.float32)
    # Both classes weigh the same in the fit; the shares of all labels then set the intercept.
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    beta, bias = np.zeros(len(chosen), np.float32), 0.0
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(x @ beta + bias, -30, 30)))
        miss = ((p - y) * weight).astype(np.float32)
        slope = np.append(x.T @ miss + 1e-4 * beta, miss.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        beta -= move[:-1].astype(np.float32)
        bias -= float(move[-1])
    weights = empty
    weights[chosen] = beta * ratio[chosen]
    return Model(weights, bias + math.log(share[1] / share[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a column ``score``."""
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    bias = model.intercept

    def run(batches):
        weights = shared.value
        wanted = weights != 0
        for batch in batches:
            for part in slices(batch):
                row, bins = _hits(part.column("text"), wanted)
                logit = bias + np.bincount(row, weights=weights[bins], minlength=part.num_rows)
                value = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], names=[*part.schema.names, "score"])

    return docs.transform(in_arrow, run, schema)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
