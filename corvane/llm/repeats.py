"""Removal of long repeated substrings, exactly, over texts of any number.

Every string of LENGTH bytes holds one anchor: its GRAM-byte piece of least
hash, the leftmost of equals. Where a string occurs it has the same anchor at
the same place, so strings can only be equal among stretches (runs of string
starts with one anchor) of the same anchor.

1. Texts are written in blocks of a few MB. Each block tells its distinct
   anchors, six bytes each, to the bucket of their hash. A bucket answers
   with a bit for each: found in two documents or not; anchors in one document
   go no further. Anchors in very many blocks (``crowd``) are cut again by FINE-byte
   anchors, so that no bucket meets all contexts of a common line.
2. Blocks send the distinct stretches of the others, with their documents and
   places, to the anchors' buckets.
3. A bucket makes equal stretches one. Part by part, the stretches of each
   anchor's least document are held in a run-compressed index, and those of all
   other documents are streamed through it: a place whose matching statistic
   reaches LENGTH repeats that document. Stretches with places that don't are
   indexed in turn, and streamed through the ranges that share LENGTH bytes.
4. Places whose least document is smaller than their own go back to the blocks,
   where each document drops the bytes that marked strings cover.

Defined results: a null or empty text has no bytes; rows without ``doc_id`` are
neither compared nor changed; rows that share a ``doc_id`` are one document,
and don't remove each other; an empty table gives no rows; further columns are
ignored. A text is never split between blocks, but is anchored a segment at
a time. Blocks and what they send are compressed; nothing is gathered but a block's own marks and a bucket's stretches.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Prefix, Scratch, groups, in_arrow, mix64, slices, utf8
from .run_index import RunIndex

LENGTH, GRAM, FINE = 50, 20, 42
_PLACE = 20
#: Bytes of an anchor's hash that are told and counted: two anchors that share these are only sent for nothing.
TOLD = 6
BLOCKS = "block long, n_bytes long, ids binary, ends binary, data binary"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


class Sizes(NamedTuple):
    """What is worked on at once; results don't depend on it."""

    #: Blocks that hold an anchor from which on it is cut finer.
    crowd: int = 256
    #: Bytes whose strings are anchored at once, of texts in a block, of texts for each bucket, and of stretches in an index.
    segment: int = 1 << 18
    block: int = 4 << 20
    bucket: int = 32 << 20
    index: int = 1 << 18


def _anchored(data: np.ndarray, offsets: np.ndarray, gram: int, allowed: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Of all stretches of one segment: the first start, the number of starts, and the anchor's hash."""
    n = len(data) - LENGTH + 1
    hashes = Prefix(data).every(gram)
    # The least hash of each window, with its place: by halves, as in a doubling table.
    least = ((hashes >> U64(_PLACE)) << U64(_PLACE)) | np.arange(len(hashes), dtype=U64)
    span, width = 1, LENGTH - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    anchor = (least & U64((1 << _PLACE) - 1)).astype(np.int32)
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:].astype(np.int32), sizes)[:n]
    whole = np.arange(LENGTH, n + LENGTH, dtype=np.int32) <= ends
    if allowed is not None:
        whole &= allowed[:n]
    new = whole.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (ends[1:] != ends[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | new[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last) - first + 1, hashes[anchor[first]]


def stretches(data: np.ndarray, offsets: np.ndarray, segment: int, gram: int = GRAM, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The first start, the number of starts and the anchor's hash (even numbers) of each stretch of a block's texts."""
    found = []
    for a in range(0, max(0, len(data) - LENGTH + 1), segment):
        b = min(len(data), a + segment + LENGTH - 1)
        i, j = np.searchsorted(offsets, a, side="right"), np.searchsorted(offsets, b, side="left")
        local = np.concatenate([[0], offsets[i:j] - a, [b - a]])
        if allowed is None or allowed[a:b].any():
            first, count, h = _anchored(data[a:b], local, gram, None if allowed is None else allowed[a:b])
            found.append((first + a, count, h))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    first, count, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # A least hash is a small one: mixed again, so that buckets get as many.
    return first, count, mix64(h) & ~U64(1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets ascend with hashes."""
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64), [len(keys)]])


def _shrink(data: bytes | np.ndarray) -> bytes:
    """Compressed, behind its length."""
    raw = data if isinstance(data, bytes) else data.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _grow(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def _shrink_numbers(values: np.ndarray, width: int = 8) -> bytes:
    """Numbers by their first bytes, second bytes ... up to ``width``: those that hardly change take no room."""
    return _shrink(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)[:, :width].T)


def _grow_numbers(data: bytes, kind: str, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(_grow(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(kind)


def _packed(batches, size: int):
    """Rows to blocks of whole texts."""
    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", size):
            data, offsets = utf8(part.column("text"))
            ids = np.asarray(part.column("doc_id").fill_null(0), dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(data)]), *(pa.array([x], pa.binary()) for x in (_shrink_numbers(ids), _shrink_numbers(offsets[1:].astype("<i8")), _shrink(data)))], names=["block", "n_bytes", "ids", "ends", "data"])
            at += 1


class _Block:
    def __init__(self, batch: pa.RecordBatch, row: int):
        value = lambda name: batch.column(name)[row].as_py()
        self.number = value("block")
        self.ids, self.data = _grow_numbers(value("ids"), "<i8"), np.frombuffer(_grow(value("data")), np.uint8)
        self.offsets = np.concatenate([[0], _grow_numbers(value("ends"), "<i8")])

    def text_of(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, start, side="right") - 1

    def anchors(self, segment: int) -> tuple[np.ndarray, ...]:
        """All stretches by anchor: starts, counts, hashes; and where each distinct anchor's begin."""
        start, count, h = stretches(self.data, self.offsets, segment)
        order = np.argsort(h, kind="stable")
        h = h[order]
        return start[order], count[order], h, _edges(h)


def _blocks_of(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch, row, _Block(batch, row)


def _tell(batches, buckets: int, segment: int):
    """A block's distinct anchors by bucket, the first TOLD bytes of each; the last bit says that two of its documents hold one."""
    for _, _, block in _blocks_of(batches):
        start, _, h, edges = block.anchors(segment)
        if not len(h):
            continue
        ids = block.ids[block.text_of(start)]
        several = np.minimum.reduceat(ids, edges[:-1]) < np.maximum.reduceat(ids, edges[:-1])
        bucket = _bucket(h[edges[:-1]], buckets)
        told = (h[edges[:-1]] >> U64(65 - 8 * TOLD) << U64(1)) | several.astype(U64)
        cut = _edges(bucket)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[cut[:-1]]), pa.array(np.full(len(cut) - 1, block.number)), pa.array([_shrink_numbers(told[a:b].astype("<u8"), TOLD) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
            names=["bucket", "block", "told"],
        )


def _answer(batches, crowd: int):
    """For each block's anchors in a bucket: a bit for those in two documents, then one for those in ``crowd`` blocks (if any)."""
    for group in groups(batches, ["bucket"]):
        raw = [_grow_numbers(x, "<u8", TOLD) for x in group.column("told").to_pylist()]
        told = np.concatenate(raw).astype(U64)
        h = told >> U64(1)
        order = np.argsort(h)
        edges = _edges(h[order])
        size = np.diff(edges)
        several = np.maximum.reduceat((told & U64(1))[order], edges[:-1]) > 0
        shared, crowded = np.empty(len(h), bool), np.empty(len(h), bool)
        shared[order], crowded[order] = np.repeat((size > 1) | several, size), np.repeat((size >= crowd) & ((size > 1) | several), size)
        ends = np.cumsum([len(x) for x in raw])
        bits, keep = [], []
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if shared[a:b].any():
                keep.append(i)
                bits.append(np.packbits(shared[a:b]).tobytes() + (np.packbits(crowded[a:b]).tobytes() if crowded[a:b].any() else b""))
        rows = group.take(pa.array(keep, pa.int64())).combine_chunks()
        if len(keep):
            yield pa.RecordBatch.from_arrays([rows.column("bucket").chunk(0), rows.column("block").chunk(0), pa.array(bits, pa.binary())], names=["bucket", "block", "bits"])


def _send(batches, buckets: int, segment: int):
    """The distinct stretches of a block that another document may share, by bucket."""
    names = [c.split()[0] for c in SENT.split(", ")]
    for batch, row, block in _blocks_of(batches):
        start, count, h, edges = block.anchors(segment)
        bucket = _bucket(h[edges[:-1]], buckets)
        cut = _edges(bucket)
        where = dict(zip(bucket[cut[:-1]].tolist(), zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True), strict=True))
        shared, crowded = np.zeros(len(edges) - 1, bool), np.zeros(len(edges) - 1, bool)
        for x in batch.column("answers")[row].as_py():
            a, b = where[x["bucket"]]
            bits, half = np.frombuffer(x["bits"], np.uint8), (b - a + 7) // 8
            shared[a:b] = np.unpackbits(bits[:half], count=b - a)
            if len(bits) > half:
                crowded[a:b] = np.unpackbits(bits[half:], count=b - a)
        size = np.diff(edges)
        plain, fine = np.repeat(shared & ~crowded, size), np.repeat(crowded, size)
        if fine.any():
            allowed = np.zeros(len(block.data) + 1, np.int64)
            np.add.at(allowed, start[fine], 1)
            np.add.at(allowed, start[fine] + count[fine], -1)
            s, c, f = stretches(block.data, block.offsets, segment, FINE, np.cumsum(allowed)[:-1] > 0)
            start, count, h = (np.concatenate(x) for x in zip((start[plain], count[plain], h[plain]), (s, c, f), strict=True))
            order = np.argsort(h, kind="stable")
            start, count, h = start[order], count[order], h[order]
        else:
            start, count, h = start[plain], count[plain], h[plain]
        if not len(h):
            continue
        # Equal stretches of the block travel once, with all their documents and places.
        raw, seen, contents, keep = memoryview(block.data.tobytes()), {}, [], []
        of = np.empty(len(h), np.int64)
        for i, (a, b) in enumerate(zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)):
            content = bytes(raw[a:b])
            of[i] = u = seen.setdefault(content, len(contents))
            if u == len(contents):
                contents.append(content)
                keep.append(i)
        order = np.argsort(of, kind="stable")
        places, docs = start[order].astype("<i8"), block.ids[block.text_of(start[order])].astype("<i8")
        times = np.bincount(of, minlength=len(contents)).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
        h = h[keep].astype("<u8")
        sizes = np.fromiter(map(len, contents), "<u2", len(contents))
        bucket = _bucket(h, buckets)
        cut = _edges(bucket)
        rows = [
            (_shrink(h[a:b]), _shrink(sizes[a:b]), _shrink(b"".join(contents[a:b])), _shrink_numbers(times[a:b], 4), _shrink_numbers(docs[ends[a] : ends[b]]), _shrink_numbers(places[ends[a] : ends[b]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(np.full(len(rows), block.number)), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=names)


SENT = "bucket long, block long, h binary, sizes binary, contents binary, times binary, docs binary, places binary"


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1 ... n - 1 for each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def least_documents(texts: list[bytes], owners: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of starts of each distinct stretch, and for each start the least owner of a stretch with the same string.

    Anchors come in one run each, their owners ascending.
    """
    edges = _edges(h)
    size = np.diff(edges)
    # Ranks stand for owners: -1 is no owner, and ids may be negative.
    by_rank, ranks = np.unique(owners, return_inverse=True)
    leads = owners == np.repeat(owners[edges[:-1]], size)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = lengths - LENGTH + 1
    begin = np.cumsum(n) - n
    out = np.repeat(ranks, n)

    def streamed(which: np.ndarray, index: RunIndex) -> np.ndarray:
        """The stretches with places that the index doesn't hold; the others' least owners are taken."""
        _, _, least = index.stream([texts[i] for i in which.tolist()])
        step, times = _steps(n[which]), n[which]
        found = least[np.repeat(np.cumsum(lengths[which]) - lengths[which], times) + step]
        into = np.repeat(begin[which], times) + step
        out[into] = np.where(found >= 0, np.minimum(found, out[into]), out[into])
        return which[np.minimum.reduceat(found, np.cumsum(times) - times) < 0]

    first, left = np.flatnonzero(leads), np.flatnonzero(~leads)
    if len(left):
        left = streamed(left, RunIndex([texts[i] for i in first.tolist()], ranks[first], LENGTH))
    # A stretch alone in its anchor has nothing more to share.
    anchor = np.repeat(np.arange(len(size)), size)[left]
    left = left[np.bincount(anchor, minlength=len(size))[anchor] > 1]
    if len(left):
        streamed(left, RunIndex([texts[i] for i in left.tolist()], ranks[left], LENGTH))
    return n, by_rank[out]


def _find(batches, index_bytes: int):
    """Starts in each block whose string a smaller document holds, as runs."""
    for group in groups(batches, ["bucket"]):
        column = lambda name, kind: [np.frombuffer(_grow(x), kind) for x in group.column(name).to_pylist()]  # noqa: B023, E731
        numbers = lambda name, kind, width=8: [_grow_numbers(x, kind, width) for x in group.column(name).to_pylist()]  # noqa: B023, E731
        # Distinct stretches of all blocks, and all occurrences.
        seen, contents, hashes, of = {}, [], [], []
        for raw, sizes, h in zip(map(_grow, group.column("contents").to_pylist()), column("sizes", "<u2"), column("h", "<u8"), strict=True):
            ends = np.cumsum(sizes, dtype=np.int64)
            for a, b, key in zip((ends - sizes).tolist(), ends.tolist(), h.tolist(), strict=True):
                content = raw[a:b]
                u = seen.setdefault(content, len(contents))
                if u == len(contents):
                    contents.append(content)
                    hashes.append(key)
                of.append(u)
        del seen, raw
        times = numbers("times", "<u4", 4)
        u = np.repeat(np.asarray(of, dtype=np.int64), np.concatenate(times))
        doc, place = np.concatenate(numbers("docs", "<i8")), np.concatenate(numbers("places", "<i8"))
        block = np.repeat(np.asarray(group.column("block")), [int(t.sum()) for t in times])
        owner = np.full(len(contents), np.iinfo(np.int64).max)
        np.minimum.at(owner, u, doc)
        h = np.asarray(hashes, dtype=U64)
        order = np.lexsort((owner, h))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[u], kind="stable")
        u, doc, place, block = rank[u][by], doc[by], place[by], block[by]
        contents, owner, h = [contents[i] for i in order.tolist()], owner[order], h[order]
        size = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
        anchors = _edges(h)
        starts, blocks = [], []
        a = 0
        while a < len(contents):
            # Whole anchors, up to about ``index_bytes``.
            b = int(anchors[np.searchsorted(anchors, np.searchsorted(size, size[a] + index_bytes, side="left"), side="left")]) if size[a] + index_bytes < size[-1] else len(contents)
            lengths, flat = least_documents(contents[a:b], owner[a:b], h[a:b])
            i, j = np.searchsorted(u, (a, b))
            begin = np.cumsum(lengths) - lengths
            mine = u[i:j] - a
            n = lengths[mine]
            step = _steps(n)
            hit = np.flatnonzero(flat[np.repeat(begin[mine], n) + step] < np.repeat(doc[i:j], n))
            starts.append((np.repeat(place[i:j], n) + step)[hit])
            blocks.append(np.repeat(block[i:j], n)[hit])
            a = b
        start, block = np.concatenate(starts), np.concatenate(blocks)
        order = np.lexsort((start, block))
        start, block = start[order], block[order]
        new = np.ones(len(start), bool)
        new[1:] = (block[1:] != block[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        runs = np.stack([start[first], np.diff(np.append(first, len(start)))], axis=1).astype("<i8")
        cut = _edges(block[first])
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(block[first][cut[:-1]]), pa.array([runs[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["block", "marks"])


def _remaining(batches):
    """What is left of each text of a block, with its figures."""
    for batch, row, block in _blocks_of(batches):
        n = len(block.ids)
        marks = batch.column("marks")[row].as_py() or []
        runs = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        low, high = runs[:, 0], runs[:, 0] + runs[:, 1] + LENGTH - 1
        text = block.text_of(low)
        reach = np.maximum.accumulate(high) if len(high) else high
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] > reach[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        low, text = low[first], text[first]
        high = np.maximum.reduceat(high, first) if len(first) else high
        removed, spans = np.bincount(text, weights=high - low, minlength=n).astype(np.int64), np.bincount(text, minlength=n)
        at = np.concatenate([[0], np.cumsum(spans)]).tolist()
        raw, low, high = memoryview(block.data.tobytes()), low.tolist(), high.tolist()
        edges = block.offsets.tolist()
        kept = []
        for i in range(n):
            cuts = [edges[i], *(x for k in range(at[i], at[i + 1]) for x in (low[k], high[k])), edges[i + 1]]
            kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in (block.ids, np.diff(block.offsets), removed, spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
            names=[c.split()[0] for c in DIGESTS.split(", ")],
        )


def remove_repeats(spark: SparkSession, docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each row."""
    scratch = Scratch(spark, "repeats")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.cut(source.where("doc_id is not null").transform(in_arrow, lambda rows: _packed(rows, sizes.block), BLOCKS), "blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // sizes.bucket))
    dealt = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    told = blocks.transform(in_arrow, lambda rows: _tell(rows, buckets, sizes.segment), "bucket long, block long, told binary")
    answers = dealt(told).transform(in_arrow, lambda rows: _answer(rows, sizes.crowd), "bucket long, block long, bits binary")
    answers = scratch.cut(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), "answers")
    sent = blocks.join(answers, "block").transform(in_arrow, lambda rows: _send(rows, buckets, sizes.segment), SENT)
    found = dealt(sent).transform(in_arrow, lambda rows: _find(rows, sizes.index), "block long, marks binary")
    marks = scratch.cut(found.groupBy("block").agg(F.collect_list("marks").alias("marks")), "marks")
    scratch.drop("answers")
    left = blocks.join(marks, "block", "left").transform(in_arrow, _remaining, DIGESTS)
    alone = source.where("doc_id is null").transform(in_arrow, lambda rows: _packed(rows, sizes.block), BLOCKS).withColumn("marks", F.lit(None).cast("array<binary>"))
    return left.unionByName(alone.transform(in_arrow, _remaining, DIGESTS).withColumn("doc_id", F.lit(None).cast("long")))
