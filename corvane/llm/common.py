"""What the training-data operators share: scratch tables, tasks of bounded memory, and text arrays."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that one slice of a batch holds at most (a longer text stands alone).
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to a worker, at most but for its last row.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker remembers from task to task, by operator.
CACHES: dict[str, dict] = {}


def _release(keep: str = "") -> None:
    """Give a worker's free memory back: workers live on, and the next task may be another operator's."""
    _POWERS.clear()
    for name in [n for n in CACHES if n != keep]:
        del CACHES[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def in_arrow(df: DataFrame, run, schema, keep: str = "") -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, whose worker keeps nothing after its task but the cache ``keep``.

    The bound is a setting of the session, as Spark has none for a single plan; a smaller one stays as it is.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    have = str(conf.get(key, None) or "").rstrip("bB")
    if not have.isdigit() or int(have) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _release(keep)

    return df.mapInArrow(task, schema)


class Scratch:
    """Tables in the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage, outlives its executors, and tells the
    planner its real size. The session's folder is taken; where none is set, a
    temporary one is on one machine, and a cluster is refused.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.gettempdir() + "/corvane-checkpoints"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """The rows as a written table; the shuffle files that the writing took go with its end."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str | tuple[str, ...] = "text", limit: int = SLICE_BYTES):
    """The batch in runs of rows with about ``limit`` bytes of text each, in one or several columns."""
    columns = (column,) if isinstance(column, str) else column
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), dtype=np.int64) for c in columns)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and where each begins (null: empty)."""
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        out = np.full(max(n, 1 << 16), base, dtype=U64)
        out[0] = 1
        _POWERS[kind] = have = np.multiply.accumulate(out)
    return have[:n]


class Prefix:
    """Hashes of any stretch of a byte array, from one running sum.

    Byte i adds value(byte) * B**i modulo 2**64; a stretch's sum times B**-start
    doesn't depend on where the stretch stands.
    """

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE[data] * _powers("up", len(data)), out=self.sums[1:])
        self.down = _powers("down", len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def every(self, k: int) -> np.ndarray:
        """Of the k bytes from each place on."""
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


#: Stretches up to this length are hashed by running sums, longer ones one by one, and the bytes that are summed at once.
SHORT, SUMMED = 48, 1 << 18


def stretch_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch, which come in order of their starts.

    Running sums modulo 2**64 tell short stretches apart; of long ones some have
    equal sums for any base (the Thue-Morse words), so these take BLAKE2b.
    """
    out = np.zeros(len(start), U64)
    size = end - start
    short = np.flatnonzero(size <= SHORT)
    cuts = np.searchsorted(start[short], np.arange(0, len(data) + SUMMED, SUMMED))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        which, at = short[cuts[k] : cuts[k + 1]], k * SUMMED
        out[which] = Prefix(data[at : at + SUMMED + SHORT]).of(start[which] - at, end[which] - at)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each one's text."""
    inner = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inner[:-1]]) if len(data) else inner
    starts = np.flatnonzero(inner & (~before | edge[:-1]))
    after = np.concatenate([inner[1:], [False]]) if len(data) else inner
    ends = np.flatnonzero(inner & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out *= U64(_BASE)
        out += values[j : j + n]
    return mix64(out)


def groups(batches, keys: list[str]):
    """Runs of rows with equal keys, whole, from batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
