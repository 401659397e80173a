"""Near duplicates: universal hash minima, bands, verification, components.

A text's set is its distinct five-word shingles. Texts with the same set form a
class, and its least document stands for it; classes meet in bands of minima.
In each bucket the member that shares most with others leads, and all members
are held against it: first sizes and signatures, with a margin that a true
link passes, then the full sets of the whole texts. Components of the
confirmed links follow. A leader's family that is not yet in one component is
searched again in blocks, every member against those of other components, so
no candidate pair goes untested unless its ends are joined anyway; the blocks
return pairs of components that meet, never pairs of documents.

The threshold sets the bands, their minima and the least agreement of two
signatures (``limits``), so that a pair at it shares no band with probability
(1 - 0.85**5)**26 at 85 % and (1 - 0.8**4)**29 at 80 %, about 2 in 10**7.

Defined results: null and empty texts and rows without ``doc_id`` have no links
and stay; rows that share an id are one document, whatever their texts;
repeated rows share a class, so a component's least document may be
kept more than once if its row is; an empty table gives no rows; further
columns are ignored by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, fold_ascii, groups, in_arrow, mix64, slices, stretch_hashes, utf8, windows, word_spans
from .components import components

WORDS = 5
#: Links have 100 * |intersection| >= PERCENT * |union|, unless another share is asked for.
PERCENT = 85
#: Members of a block of a family, and shingles that are multiplied at once.
BLOCK, WIDE = 256, 4096
#: Bits of the map that keeps texts nobody asks for out of a shuffle.
SLOTS = 1 << 24
SIGNATURES = "doc_id long, t long, n_shingles long, c1 long, c2 long, bands array<long>, minima binary"


class Limits(NamedTuple):
    """What a threshold sets: bands of minima, and the equal minima that a candidate needs."""

    percent: int
    bands: int
    rows: int
    least_equal: int

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def limits(percent: int = PERCENT) -> Limits:
    """Enough bands that a pair at the threshold shares none in under 2.5 of 10**7, and an agreement that it misses in under one of 10**8."""
    s, rows = percent / 100, 5 if percent >= 85 else 4
    bands = math.ceil(math.log(2.5e-7) / math.log1p(-(s**rows)))
    n, missed, least = bands * rows, 0.0, 0
    while (missed := missed + math.comb(n, least) * s**least * (1 - s) ** (n - least)) < 1e-8:
        least += 1
    return Limits(percent, bands, rows, least)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, by text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    data = fold_ascii(data)
    starts, ends, of = word_spans(data, offsets)
    hashes = stretch_hashes(data, starts, ends)
    five = windows(hashes, WORDS)
    good = of[: len(five)] == of[WORDS - 1 :] if len(five) else np.zeros(0, bool)
    rows, values = [of[: len(five)][good]], [five[good]]
    count = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    for k in range(1, WORDS):
        short = np.flatnonzero(count == k)
        if len(short):
            value = np.full(len(short), k, dtype=U64)
            for j in range(k):
                value = mix64(value * U64(0x9E3779B97F4A7C15) + hashes[first[short] + j])
            rows.append(short)
            values.append(value)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _signatures(batches, link: Limits):
    a = mix64(np.arange(1, link.minima + 1, dtype=U64)) | U64(1)
    b = mix64(np.arange(1001, 1001 + link.minima, dtype=U64))
    for batch in batches:
        for part in slices(batch):
            n = part.num_rows
            row, value = shingles(part.column("text"))
            size = np.bincount(row, minlength=n)
            has = np.flatnonzero(size)
            at = np.concatenate([[0], np.cumsum(size[has])])[:-1].astype(np.int64)
            minima = np.zeros((n, link.minima), np.uint32)
            sums = np.zeros((2, n), np.int64)
            if len(has):
                for k in range(link.minima):
                    minima[has, k] = np.minimum.reduceat((value * a[k] + b[k]) >> U64(32), at)
                for k, salt in enumerate((U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F))):
                    sums[k, has] = np.add.reduceat(mix64(value ^ salt), at).view(np.int64)
            band = np.zeros((n, link.bands), U64)
            for k in range(link.bands):
                key = np.full(n, k + 1, dtype=U64)
                for j in range(link.rows):
                    key = mix64(key * U64(0x9E3779B97F4A7C15) + minima[:, k * link.rows + j])
                band[:, k] = key
            kept = band[has].reshape(-1).view(np.int64)
            edges = np.concatenate([[0], np.cumsum(np.where(size > 0, link.bands, 0))])
            small = (minima & 0xFFFF).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("t"),
                    pa.array(size, pa.int64()),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(kept)),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                ],
                names=[f.split()[0] for f in SIGNATURES.split(", ")],
            )


def _agree(batches, link: Limits):
    """Candidates whose signatures agree in enough places."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, link.minima) for c in ("sa", "sb"))
        keep = pa.array((x == y).sum(axis=1) >= link.least_equal)
        out = batch.filter(keep)
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])


def _confirm(batches, link: Limits):
    """Candidates whose full sets overlap enough."""
    for batch in batches:
        for part in slices(batch, ("ta", "tb")):
            n = part.num_rows
            ra, va = shingles(part.column("ta"))
            rb, vb = shingles(part.column("tb"))
            salt = mix64(np.arange(1, n + 1, dtype=U64))
            _, ia, _ = np.intersect1d(va ^ salt[ra], vb ^ salt[rb], assume_unique=True, return_indices=True)
            both = np.bincount(ra[ia], minlength=n)
            union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
            out = part.filter(pa.array((100 * both >= link.percent * union) & (union > 0)))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["u", "v"])


def _blocks(members: DataFrame) -> DataFrame:
    """Members of each family in blocks of about BLOCK, once for each pair of blocks they are part of."""
    sizes = members.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(sizes, "lead").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("own", "other", "blocks")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("lead", "bi", "bj").sortWithinPartitions("lead", "bi", "bj")


def _partnered(batches, link: Limits):
    """Members whose signature comes near one of another component."""
    for group in groups(batches, ["lead", "bi", "bj"]):
        comp, n = (np.asarray(group.column(c)) for c in ("comp", "n_shingles"))
        minima = np.frombuffer(b"".join(group.column("minima").to_pylist()), "<u2").reshape(len(comp), -1)
        equal = np.zeros((len(comp), len(comp)), np.uint16)
        for k in range(minima.shape[1]):
            equal += minima[:, k, None] == minima[None, :, k]
        near = (equal >= link.least_equal) & (comp[:, None] != comp[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= link.percent * np.maximum(n[:, None], n[None, :]))
        rows = group.filter(pa.array(near.any(axis=1))).select(["lead", "rep", "comp"])
        yield from rows.to_batches()


def _merging(batches, link: Limits):
    """Pairs of components with a confirmed link between members of a block."""
    for group in groups(batches, ["lead", "bi", "bj"]):
        comp = np.asarray(group.column("comp"))
        rows, values, at = [], [], 0
        for batch in group.select(["text"]).to_batches():
            for part in slices(batch):
                row, value = shingles(part.column("text"))
                rows.append(row + at)
                values.append(value)
                at += part.num_rows
        row = np.concatenate(rows)
        size = np.bincount(row, minlength=at)
        _, code, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        row, code = row[shared[code]], place[code[shared[code]]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        both = np.zeros((at, at), np.float32)
        for a in range(0, int(shared.sum()), WIDE):
            i, j = np.searchsorted(code, (a, a + WIDE))
            has = np.zeros((at, min(WIDE, int(shared.sum()) - a)), np.float32)
            has[row[i:j], code[i:j] - a] = 1
            both += has @ has.T
        union = size[:, None] + size[None, :] - both
        x, y = np.nonzero((100 * both >= link.percent * union) & (comp[:, None] < comp[None, :]))
        pairs = np.unique(np.stack([comp[x], comp[y]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])


def _of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of the classes ``reps`` (rep, doc_id, t), by a bitmap of SLOTS hashes before the exact join.

    The bitmap's size is fixed; over very many ids it only lets more rows pass.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    marks = reps.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s % 64 AS INT))")).alias("m")).toArrow()
    bitmap = np.zeros(SLOTS // 64, np.int64)
    bitmap[np.asarray(marks.column("w"))] = np.asarray(marks.column("m"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(U64))

    def passing(batches):
        for batch in batches:
            s = np.asarray(batch.column("slot"))
            keep = (shared.value[s >> 6] >> (s & 63).astype(U64)) & U64(1) == 1
            yield batch.filter(pa.array(keep)).select(["doc_id", "t", "text"])

    few = docs.where("doc_id is not null").select("doc_id", "t", "text", slot.alias("slot")).transform(in_arrow, passing, "doc_id long, t long, text string")
    # A row and its repetitions are one; the class is told by the text's hash, and texts are compared whole afterwards.
    return few.groupBy("doc_id", "t").agg(F.min("text").alias("text")).join(reps, ["doc_id", "t"]).select("rep", "text")


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, link: Limits) -> DataFrame:
    """The confirmed ones of candidate pairs (a, b)."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("minima").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {link.percent} * greatest(na, nb)")
    likely = scratch.cut(sized.select("a", "b", "sa", "sb").transform(in_arrow, lambda rows: _agree(rows, link), "a long, b long"), "likely")
    met = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
    few = _of(docs, reps.select("rep", "doc_id", "t").join(met, "rep", "left_semi"))
    text = lambda x: few.select(F.col("rep").alias(x), F.col("text").alias(f"t{x}"))
    return likely.join(text("b"), "b").join(text("a"), "a").transform(in_arrow, lambda rows: _confirm(rows, link), "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    link = limits(percent)
    scratch = Scratch(spark, "neardup")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    signed = scratch.cut(source.transform(in_arrow, lambda rows: _signatures(rows, link), SIGNATURES), "signatures")
    key = ["n_shingles", "c1", "c2"]
    has = signed.where("n_shingles > 0 and doc_id is not null")
    # Each class has a number, fixed once it is written, and one row that stands for it.
    first = has.groupBy(*key).agg(F.min(F.struct("doc_id", "t")).alias("first")).select(*key, "first.*")
    classes = scratch.cut(first.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = scratch.cut(has.join(classes, [*key, "doc_id", "t"]).dropDuplicates(["rep"]).select("rep", "doc_id", "t", "n_shingles", "bands", "minima"), "reps")
    members = scratch.cut(signed.select("doc_id", *key).join(classes.select(*key, "rep"), key, "left"), "members")
    # Texts under one id are one document: it ties their classes.
    several = members.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v")
    tied = members.join(several.select("doc_id", "u"), "doc_id").select("u", F.col("rep").alias("v")).where("v is not null and u < v")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    counts = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = scratch.cut(banded.join(counts, "key"), "buckets")
    degree = buckets.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = buckets.select("key", "rep").join(degree, "rep")
    leads = ranked.groupBy("key").agg(F.max(F.struct("degree", -F.col("rep"))).alias("top")).select("key", (-F.col("top.col2")).alias("lead"))
    stars = buckets.select("key", "rep").join(leads, "key").where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    tested = scratch.cut(stars, "stars")
    links = scratch.cut(_links(tested, reps, source, scratch, link), "links")
    joined = components(links.unionByName(tied), scratch, "first")
    # Families (a leader and all it was held against) that are not yet in one component: in blocks,
    # first by signatures, then the full sets of those that may have a partner elsewhere.
    family = tested.select(F.col("a").alias("lead"), F.col("b").alias("rep")).unionByName(tested.select(F.col("a").alias("lead"), F.col("a").alias("rep")).distinct())
    placed = family.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("lead", "rep", F.coalesce("root", "rep").alias("comp"))
    mixed = placed.groupBy("lead").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("lead")
    open_ = scratch.cut(placed.join(mixed, "lead", "left_semi"), "open")
    signed_open = _blocks(open_).join(reps.select("rep", "n_shingles", "minima"), "rep")
    maybe = scratch.cut(_by_block(signed_open).transform(in_arrow, lambda rows: _partnered(rows, link), "lead long, rep long, comp long").distinct(), "maybe")
    texts = _of(source, reps.select("rep", "doc_id", "t").join(maybe.select("rep").distinct(), "rep", "left_semi"))
    more = scratch.cut(_by_block(_blocks(maybe.join(texts, "rep"))).transform(in_arrow, lambda rows: _merging(rows, link), "u long, v long").distinct(), "more")
    if more.isEmpty():
        final = joined
    else:
        roots = joined.select(F.col("node").alias("u"), F.col("root").alias("v"))
        final = components(roots.unionByName(more), scratch, "second")
    rooted = classes.select("rep", "doc_id").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "doc_id")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("group"))
    groups_ = scratch.cut(rooted.select("rep", "root").join(least, "root").select("rep", "group"), "groups")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    out = members.join(groups_, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component."""
    judged = Scratch(spark, "neardup-kept").cut(near_duplicates(spark, docs, percent).where("not kept").select("doc_id"), "gone")
    gone = judged.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
