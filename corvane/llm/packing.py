"""Packing documents into sequences of a fixed length.

Only piece lengths matter to a packing, and there are at most ``capacity`` of
them, so the driver packs a histogram: first Martello and Toth's dominance
reduction fixes small sets that no other set containing the same piece can
beat, then the rest goes best-fit in falling order of length. The outcome is a
short list of intervals of ranks within a length; every piece finds its place
by its own rank, with no shuffle of texts.

Defined results: a null or empty text is the end id alone; repeated rows and
repeated ids are packed each on its own; an empty table gives no rows; further
columns are ignored.
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

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, local_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_SHIFT = 44


def _histogram_reduce(c: np.ndarray, capacity: int, fix) -> None:
    """Fix dominating sets. c[w] counts the free pieces of length w; fix(sizes, times) takes them."""

    def largest(limit: int) -> int:
        found = np.flatnonzero(c[1 : limit + 1]) if limit > 0 else ()
        return int(found[-1]) + 1 if len(found) else 0

    def smallest(n: int) -> list[int]:
        out: list[int] = []
        for w in np.flatnonzero(c):
            out += [int(w)] * int(min(c[w], n - len(out)))
            if len(out) == n:
                break
        return out

    def times(*sizes: int) -> int:
        return min(int(c[s]) // sizes.count(s) for s in sizes)

    for w in range(capacity, 0, -1):
        while c[w]:
            c[w] -= 1
            rest = capacity - w
            k, low = largest(rest), smallest(3)
            chosen: tuple[int, ...] = ()
            if not k:
                chosen = (w,)
            elif k == rest or len(low) < 2 or w + low[0] + low[1] > capacity:
                chosen = (w, k)
            elif len(low) < 3 or w + sum(low) > capacity:
                # At most two more fit: the largest one alone, or a pair.
                c[k] -= 1
                b = largest(rest - k)
                c[k] += 1
                half, most, second = largest(rest // 2), 0, 0
                x = half
                while x and not second:
                    c[x] -= 1
                    y = largest(rest - x)
                    c[x] += 1
                    if y >= x:
                        second = x
                    x = largest(x - 1)
                for x in np.flatnonzero(c[1 : rest + 1]) + 1:
                    c[x] -= 1
                    y = largest(rest - int(x))
                    c[x] += 1
                    most = max(most, int(x) + y if y else 0)
                if k >= most:
                    chosen = (w, k)
                elif b and b >= second:
                    chosen = (w, k, b)
            c[w] += 1
            if not chosen:
                break
            t = int(c[w]) if chosen == (w,) else times(*chosen)
            fix(chosen, t)
            for s in chosen:
                c[s] -= t


def pack_histogram(counts: np.ndarray, capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Places for counts[w] pieces of each length w, as intervals of ranks, and the number of sequences.

    The pieces of length w with ranks from ``rank`` on stand ``per`` to a
    sequence, from ``sequence`` on, one behind the other from ``offset``.
    """
    c = np.asarray(counts, dtype=np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    total = 0

    def place(w: int, n: int, sequence: int, per: int, offset: int) -> None:
        rows.append((w, int(used[w]), sequence, per, offset))
        used[w] += n

    fixed: dict[int, list[tuple[int, int]]] = {}

    def fix(sizes: tuple[int, ...], t: int) -> None:
        nonlocal total
        at = 0
        for w in dict.fromkeys(sizes):
            per = sizes.count(w)
            place(w, t * per, total, per, at)
            at += w * per
        if at < capacity:
            fixed.setdefault(capacity - at, []).append((total, t))
        total += t

    _histogram_reduce(c, capacity, fix)
    # Best fit: each piece goes where the least room is left, among all open sequences.
    room: dict[int, list[tuple[int, int]]] = fixed
    open_ = np.zeros(capacity + 1, bool)
    open_[list(room)] = True
    for w in range(capacity, 0, -1):
        n = int(c[w])
        while n:
            fits = np.flatnonzero(open_[w:])
            r = int(fits[0]) + w if len(fits) else capacity
            per = r // w
            if len(fits):
                first, count = room[r].pop()
                if not room[r]:
                    del room[r]
                    open_[r] = False
            else:
                first, count = total, -(-n // per)
                total += count
            full = min(count, n // per)
            left = [(first, full, r - per * w)] if full else []
            if full:
                place(w, full * per, first, per, capacity - r)
                n -= full * per
            if full < count:
                more = min(n, per - 1)
                if more and n < per:
                    place(w, more, first + full, more, capacity - r)
                    n -= more
                    left.append((first + full, 1, r - more * w))
                    full += 1
                if full < count:
                    left.append((first + full, count - full, r))
            for a, k, rest in left:
                if rest:
                    room.setdefault(rest, []).append((a, k))
                    open_[rest] = True
    table = np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "per", "offset"), table.T.copy(), strict=True)), total


def cut_pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    def cut(batches):
        pid, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", tokens.SLICE_BYTES):
                ids, starts = tokens.encode_column(part.column("text"), vocabulary, end_id)
                n = np.diff(starts)
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                order = np.argsort(length, kind="stable")
                by, rank = length[order], np.empty(len(doc), np.int64)
                first = np.searchsorted(by, by, side="left")
                rank[order] = np.arange(len(by)) - first + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                raw, at = memoryview(ids.astype("<u4").tobytes()), (starts[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(doc), pid), pa.int32()),
                        pa.array(rank, pa.int64()),
                    ],
                    names=[f.split()[0] for f in PIECES.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, cut, PIECES, tokens.KEPT)


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    scratch = Scratch(spark, "packing")
    # Written once: a piece's rank within its task must not change when an executor is lost.
    pieces = scratch.cut(cut_pieces(docs, capacity, vocabulary or tokens.default_vocabulary(), end_id), "pieces")
    by_task = scratch.cut(pieces.groupBy("length", "pid").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    plan, _ = pack_histogram(counts, capacity)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    keys = (plan["length"] << _SHIFT) | plan["rank"]

    def assign(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(x)) for x in ("length", "rank"))
            i = np.searchsorted(keys, (length << _SHIFT) | rank, side="right") - 1
            into = rank - plan["rank"][i]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(plan["sequence"][i] + into // plan["per"][i], pa.int64()),
                    pa.array(plan["offset"][i] + into % plan["per"][i] * length, pa.int64()),
                ],
                names=[f.split()[0] for f in PLACED.split(", ")],
            )

    return ranked.transform(in_arrow, assign, PLACED)
