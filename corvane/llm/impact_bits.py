"""Ranked lexical search over a bit-sliced impact index.

A document's terms that some item asks for are found by exact lookup in one pass
and written as postings; corpus figures (documents, terms, document frequencies)
come from all of them. A shard of documents keeps, for each term and each bit of
its impacts, a bitmap over the shard's documents. An item's scores are its
terms' slices added by bitwise full adders, for 64 documents a word; its best
documents come from the most significant slice down, which keeps those that are
surely in and those still tied. Documents never leave their task: only each
task's best ones of each item are shuffled.

Items are the stated query set. They are taken in blocks of about BLOCK_PAIRS
terms, each with a pass of its own over the documents, and within a shard in
groups of GROUP_ITEMS with at most GROUP_TERMS terms (a longer item stands alone).

Defined results: null or empty texts have no term, and neither count as
documents nor are found; items without terms, or without an id, have no rows;
items of one id are one item with all their terms; rows without a ``doc_id``
count in the corpus' figures and aren't found; repeated rows are found each;
equal scores go by ascending id; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fold_ascii, in_arrow, slices, utf8

#: Item terms of a block, items and terms of a group; documents and postings of a shard.
BLOCK_PAIRS, GROUP_ITEMS, GROUP_TERMS, SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 256, 2048, 4096, 1 << 20
#: A term is a maximal run of these: letters and digits of ASCII, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INNER = np.ones(256, bool)
_INNER[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_POSTINGS = "doc_id long, n long, terms binary, tfs binary"
U1 = np.uint64(1)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def term_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, with repeats, and each one's text."""
    data = fold_ascii(data)
    inner = _INNER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inner[:-1]]) if len(data) else inner
    after = np.concatenate([inner[1:], [False]]) if len(data) else inner
    starts = np.flatnonzero(inner & (~before | edge[:-1]))
    ends = np.flatnonzero(inner & (~after | edge[1:])) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inner]))])
    return words, np.searchsorted(offsets, starts, side="right") - 1


def _postings(asked, batches):
    """Each document's number of terms, and which asked ones it has how often."""
    value_set = pa.array(asked.value, pa.large_binary())
    for batch in batches:
        for piece in slices(batch):
            words, owner = term_words(*utf8(piece.column("text")))
            n = np.bincount(owner, minlength=piece.num_rows)
            index = pc.index_in(words, value_set=value_set)
            hit = np.flatnonzero(np.asarray(pc.is_valid(index)))
            key = owner[hit] * len(asked.value) + np.asarray(index.fill_null(0))[hit]
            key, tf = np.unique(key, return_counts=True)
            cuts = np.searchsorted(key, np.arange(piece.num_rows + 1) * len(asked.value))
            term, tf = (key % max(1, len(asked.value))).astype("<i4"), tf.astype("<i8")
            rows = np.flatnonzero(n)
            part = lambda x, i: x[cuts[i] : cuts[i + 1]].tobytes()  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(rows)), pa.array(n[rows]), pa.array([part(term, i) for i in rows], pa.binary()), pa.array([part(tf, i) for i in rows], pa.binary())],
                names=["doc_id", "n", "terms", "tfs"],
            )


def _figures(size: int, batches):
    """A task's documents (at ``size``), terms (at ``size`` + 1), and document frequencies by term."""
    out = np.zeros(size + 2, np.int64)
    for batch in batches:
        out[size] += batch.num_rows
        out[size + 1] += pc.sum(batch.column("n")).as_py() or 0
        out[:size] += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
    at = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at])], names=["term", "c"])


class Shard:
    """Impacts of some documents, by term: bit b of each in a bitmap over the documents."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        by_id = np.argsort(doc_ids, kind="stable")
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        order = np.lexsort((place[doc], term))
        self.doc_ids, self.words = doc_ids[by_id], -(-len(doc_ids) // 64)
        self.doc, self.term, self.impact = place[doc][order], term[order], impact[order]

    def slices_of(self, terms: np.ndarray) -> np.ndarray:
        """(term, bit, word): the slices of these terms, which ascend; and a last term without any."""
        local = np.searchsorted(terms, self.term)
        mine = np.flatnonzero(terms[np.minimum(local, len(terms) - 1)] == self.term)
        local, doc, impact = local[mine], self.doc[mine], self.impact[mine]
        bits = int(impact.max(initial=0)).bit_length()
        out = np.zeros((len(terms) + 1, bits, self.words), np.uint64)
        if not len(mine):
            return out
        cell = local * self.words + doc // 64
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        at, shift, impact = cell[starts], (doc % 64).astype(np.uint64), impact.astype(np.uint64)
        for b in range(bits):
            out[at // self.words, b, at % self.words] = np.bitwise_or.reduceat(((impact >> np.uint64(b)) & U1) << shift, starts)
        return out

    def scores(self, items: list[np.ndarray]) -> np.ndarray:
        """(item, bit, word): slices of each item's scores, its terms' slices added with carries."""
        terms = np.unique(np.concatenate(items))
        planes = self.slices_of(terms)
        steps = max(map(len, items))
        bits = planes.shape[1] + steps.bit_length()
        total = np.zeros((len(items), bits, self.words), np.uint64)
        which = np.full((len(items), steps), len(terms))
        for i, item in enumerate(items):
            which[i, : len(item)] = np.searchsorted(terms, item)
        there = planes.any(axis=(1, 2))
        for j in range(steps):
            rows = np.flatnonzero(there[which[:, j]])
            if not len(rows):
                continue
            more, sums = planes[which[rows, j]], total[rows]
            carry = np.zeros((len(rows), self.words), np.uint64)
            for b in range(bits):
                old = sums[:, b]
                if b < more.shape[1]:
                    half = old ^ more[:, b]
                    sums[:, b], carry = half ^ carry, (old & more[:, b]) | (half & carry)
                else:
                    sums[:, b], carry = old ^ carry, old & carry
                    if not carry.any():
                        break
            total[rows] = sums
        return total

    def best(self, items: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item's place, doc_id and score of each item's k best documents with a score; all that tie with the last one are cut by id."""
        total = self.scores(items)
        sure = np.zeros((len(items), self.words), np.uint64)
        tied = np.bitwise_or.reduce(total, axis=1) if total.shape[1] else sure.copy()
        for b in range(total.shape[1] - 1, -1, -1):
            high = sure | (tied & total[:, b])
            n = np.bitwise_count(high).sum(axis=1)[:, None]
            tied = np.where(n > k, tied & total[:, b], np.where(n < k, tied & ~total[:, b], np.uint64(0)))
            sure = np.where(n > k, sure, high)
        item, doc = np.nonzero(np.unpackbits((sure | tied).view(np.uint8), axis=1, bitorder="little"))
        score = np.zeros(len(item), np.int64)
        for b in range(total.shape[1]):
            score += ((total[item, b, doc // 64] >> (doc % 64).astype(np.uint64)) & U1).astype(np.int64) << b
        return first_k(item, self.doc_ids[doc], score, k)


def first_k(item: np.ndarray, doc_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each item with the highest scores, smaller ids first among equals."""
    order = np.lexsort((doc_id, -score, item))
    item, doc_id, score = item[order], doc_id[order], score[order]
    start = np.flatnonzero(np.diff(item, prepend=-1))
    place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
    return item[place < k], doc_id[place < k], score[place < k]


def _groups(items: list[np.ndarray]) -> list[list[int]]:
    """Items that are searched together."""
    out: list[list[int]] = []
    size = GROUP_TERMS + 1
    for i, item in enumerate(items):
        size += len(item)
        if size > GROUP_TERMS or len(out[-1]) == GROUP_ITEMS:
            out.append([])
            size = len(item)
        out[-1].append(i)
    return out


def _search(sent, k: int, batches):
    """Each item's k best among a task's documents."""
    item_ids, items, weights, documents, length = sent.value
    groups = _groups(items)
    held = [np.zeros(0, np.int64)] * 3
    waiting: list[pa.RecordBatch] = []

    def settle():
        nonlocal held, waiting
        rows = pa.Table.from_batches(waiting).combine_chunks()
        waiting = []
        terms, tfs = (rows.column(c).to_pylist() for c in ("terms", "tfs"))
        term, tf = np.frombuffer(b"".join(terms), "<i4").astype(np.int64), np.frombuffer(b"".join(tfs), "<i8")
        doc = np.repeat(np.arange(len(terms)), [len(t) // 4 for t in terms])
        m = 50 + 50 * np.asarray(rows.column("n")) * documents // length
        shard = Shard(np.asarray(rows.column("doc_id")), doc, term, weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])))
        for group in groups:
            item, doc_id, score = shard.best([items[i] for i in group], k)
            held = [np.concatenate(x) for x in zip(held, (np.array(group)[item], doc_id, score), strict=True)]
        held = list(first_k(*held, k))

    docs = postings = 0
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("doc_id")))
        at = 0
        sizes = np.asarray(pc.binary_length(batch.column("terms")), dtype=np.int64) // 4
        for i, size in enumerate(sizes.tolist()):
            if docs and (docs == SHARD_DOCS or postings + size > SHARD_POSTINGS):
                waiting.append(batch.slice(at, i - at))
                settle()
                at, docs, postings = i, 0, 0
            docs, postings = docs + 1, postings + size
        waiting.append(batch.slice(at))
    if docs:
        settle()
    yield pa.RecordBatch.from_arrays([pa.array(item_ids[held[0]], pa.int64()), pa.array(held[1]), pa.array(held[2])], names=["item_id", "doc_id", "score"])


def _block(spark: SparkSession, docs: DataFrame, asked: list, scratch: Scratch, name: str, k: int) -> DataFrame | None:
    terms = sorted({t.encode() for r in asked for t in r["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    sent = spark.sparkContext.broadcast(terms)
    found = scratch.cut(in_arrow(docs, lambda b: _postings(sent, b), _POSTINGS), name)
    size = len(terms)
    figures = {r["term"]: r["c"] for r in in_arrow(found, lambda b: _figures(size, b), "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()}
    documents, length = figures.get(size, 0), figures.get(size + 1, 0)
    if not documents:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * figures.get(i, 0) + 1))) for i in range(size)], np.int64)
    items = [np.array(sorted(place[t.encode()] for t in r["terms"]), np.int64) for r in asked]
    query = spark.sparkContext.broadcast((np.array([r["item_id"] for r in asked], np.int64), items, weights, documents, length))
    return in_arrow(found, lambda b: _search(query, k, b), "item_id long, doc_id long, score long")


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    scratch = Scratch(spark, "impacts")
    each = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term"))
    asked = scratch.cut(each.groupBy("item_id").agg(F.collect_set("term").alias("terms")), "items")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-pairs // BLOCK_PAIRS)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        part = _block(spark, read, rows, scratch, f"postings{b}", k) if rows else None
        found += [part] if part is not None else []
    out = found[0] if found else spark.createDataFrame([], "item_id long, doc_id long, score long")
    for part in found[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle() -> str:
    words = lambda c: f"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {words("text")} AS w FROM documents WHERE text IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest({words("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT doc_id, n, unnest(w) AS term FROM n),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""
