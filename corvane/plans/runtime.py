"""Running providers and batches: retries, caches and errors as values; deadlines, cancellation and resumable logs."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import Files

#: What a provider's call gives: its value or its last error, and how often it was tried (0: from the cache).
OUTCOME = "struct<value:string,error:string,tries:int>"
_CACHES: dict[str, OrderedDict] = {}


@dataclass(frozen=True)
class Policy:
    """How a provider's calls are tried: ``tries`` at most, waiting ``wait`` seconds and twice as long each time, up to ``longest``."""

    tries: int = 3
    wait: float = 0.5
    longest: float = 30.0
    #: Answers that a worker keeps; the one used longest ago goes first.
    cache: int = 10_000

    def waits(self) -> list[float]:
        return [min(self.longest, self.wait * 2**i) for i in range(self.tries - 1)]


def resilient(load: Callable[[], Callable[[str], str]], policy: Policy | None = None, name: str | None = None) -> Callable[[Column], Column]:
    """A provider of one text to one text as a Column function that gives OUTCOME.

    The model is loaded once a task. A call that raises is tried again after a
    wait; what still fails is an error in its own row and costs no other row. A
    worker remembers answers, not errors. A null asks nothing and gives null.
    """
    policy, name = policy or Policy(), name or uuid.uuid4().hex

    def ask(model: Callable[[str], str], text: str) -> tuple[str | None, str | None, int]:
        cache = _CACHES.setdefault(name, OrderedDict())
        if text in cache:
            cache.move_to_end(text)
            return cache[text], None, 0
        for i, wait in enumerate([*policy.waits(), 0.0]):
            try:
                value = model(text)
            except Exception as e:  # whatever a provider raises is its answer to this row
                error = f"{type(e).__name__}: {e}"
                time.sleep(wait)
                continue
            cache[text] = value
            if len(cache) > policy.cache:
                cache.popitem(last=False)
            return value, None, i + 1
        return None, error, policy.tries

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = [(None, None, 0) if t is None else ask(model, t) for t in batch]
            out = pd.DataFrame(rows, columns=["value", "error", "tries"]).astype({"tries": "int32"})
            yield out.astype({"value": object, "error": object}).where(out.notna(), None)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    call = F.pandas_udf(run, OUTCOME)
    return lambda text: F.when(text.isNotNull(), call(text))


class Cancelled(RuntimeError):
    """The caller asked for an end."""


def within(spark: SparkSession, seconds: float, action: Callable[[], object], cancel: threading.Event | None = None) -> object:
    """The action's value, if its Spark jobs end within the time; else they are cancelled by their tag.

    Raises TimeoutError past the time, and Cancelled once ``cancel`` is set. Only
    jobs that the action started are ended.
    """
    tag, result = f"within-{uuid.uuid4().hex}", {}
    if cancel is not None and cancel.is_set():
        raise Cancelled("cancelled before it began")

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        spark.sparkContext.setInterruptOnCancel(True)
        try:
            result["value"] = action()
        except BaseException as e:  # handed to the caller's thread
            result["error"] = e
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    end = time.monotonic() + seconds
    while thread.is_alive() and time.monotonic() < end and not (cancel is not None and cancel.is_set()):
        thread.join(0.05)
    if thread.is_alive():
        why = Cancelled("cancelled") if cancel is not None and cancel.is_set() else TimeoutError(f"not done within {seconds:g} s")
        while thread.is_alive():  # a job may begin between a cancellation and the next
            spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(0.5)
        raise why
    if "error" in result:
        raise result["error"]
    return result["value"]


@dataclass
class ResultLog:
    """Results of runs that may end at any time: each attempt's pieces are folders that are whole or not there.

    A piece is written once under its attempt and number; written again, it
    replaces itself. Pieces without their mark of success are not read.
    """

    spark: SparkSession
    path: str

    def _pieces(self) -> list[str]:
        files = Files(self.spark, self.path)
        return [f"{a}/{p}" for a in files.names() if a.startswith("attempt=") for p in files.names(a) if "_SUCCESS" in files.names(f"{a}/{p}")]

    def attempts(self) -> int:
        return max((int(a.split("=")[1]) for a in Files(self.spark, self.path).names() if a.startswith("attempt=")), default=0)

    def write(self, results: DataFrame, attempt: int, piece: int) -> None:
        """Rows with id and status ``ok``, ``error`` or ``timeout``."""
        results.write.mode("overwrite").json(f"{self.path}/attempt={attempt:06d}/piece={piece:06d}")

    def rows(self, schema: str) -> DataFrame:
        """The last result of each id, an ``ok`` before all others: one row an id, whatever was tried how often."""
        pieces = self._pieces()
        if not pieces:
            return self.spark.createDataFrame([], f"{schema}, attempt int")
        every = self.spark.read.schema(f"{schema}, attempt int").option("basePath", self.path).json([f"{self.path}/{p}" for p in pieces])
        w = Window.partitionBy("id").orderBy((F.col("status") == "ok").desc(), F.col("attempt").desc())
        return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def pending(self, cases: DataFrame) -> DataFrame:
        """Cases without an ``ok``."""
        return cases.join(self.rows("id string, status string").where("status = 'ok'").select("id"), "id", "left_anti")


def evaluate(cases: DataFrame, work: Callable[[DataFrame], DataFrame], log: ResultLog, pieces: int = 8, seconds: float | None = None, cancel: threading.Event | None = None) -> int:
    """Run ``work`` over the cases (id, ...) that the log has no ``ok`` for, piece by piece; how many pieces were done.

    ``work`` gives rows with id and status. Pieces are dealt by a hash of the id,
    so that a run that was killed goes on with what is left. Past the deadline, or
    once cancelled, the running piece is ended and each of its cases, and of those
    after it, has a row that says ``timeout``; the next attempt takes them up.
    """
    spark, attempt = cases.sparkSession, log.attempts() + 1
    left = log.pending(cases.withColumn("id", F.col("id").cast("string"))).withColumn("_piece", F.pmod(F.xxhash64("id"), F.lit(pieces)))
    end = None if seconds is None else time.monotonic() + seconds
    for piece in range(pieces):
        mine = left.where(F.col("_piece") == piece).drop("_piece")
        try:
            room = 1e9 if end is None else end - time.monotonic()
            if room <= 0:
                raise TimeoutError("past the deadline")
            within(spark, room, lambda: log.write(work(mine), attempt, piece), cancel)  # noqa: B023
        except (TimeoutError, Cancelled) as e:
            rest = left.where(F.col("_piece") >= piece).select("id", F.lit("timeout").alias("status"), F.lit(str(e)).alias("error"))
            log.write(rest, attempt, piece)
            return piece
    return pieces
