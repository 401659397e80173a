"""Providers that fail, deadlines, resumable logs, and conversation memory over restarts."""

import os
import tempfile
import threading
import time

import pytest
from pyspark.sql import functions as F

from corvane.operators import context
from corvane.plans import runtime
from corvane.plans.runtime import Policy, ResultLog
from corvane.streaming import memory

from .conftest import DATA


def flaky():
    """Fails the first two times for each text with an e, always for "bad"."""
    seen: dict[str, int] = {}

    def model(text):
        seen[text] = seen.get(text, 0) + 1
        if text == "bad" or ("e" in text and seen[text] < 3):
            raise ValueError(f"no answer to {text}")
        return text.upper()

    return model


def test_a_failing_provider_loses_no_row(spark):
    texts = ["one", "two", None, "bad", "", "three", "two"] * 3
    call = runtime.resilient(flaky, Policy(tries=3, wait=0.001))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").coalesce(1).select("id", "t", call(F.col("t")).alias("r"))
    got = {r["id"]: (r["t"], r["r"]) for r in df.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i][1]
        if t is None:
            assert r is None
        elif t == "bad":
            assert (r["value"], r["error"], r["tries"]) == (None, "ValueError: no answer to bad", 3)
        else:
            assert (r["value"], r["error"]) == (t.upper(), None)
    assert got[0][1]["tries"] == 3 and got[7][1]["tries"] == 0  # asked again, then from the cache
    assert Policy(tries=5, wait=1, longest=3).waits() == [1, 2, 3, 3]


def test_cache_is_bounded(spark):
    call = runtime.resilient(lambda: str.upper, Policy(cache=2))
    df = spark.createDataFrame([(t,) for t in "abcab"], "t string").coalesce(1).select(call(F.col("t"))["tries"].alias("n"))
    assert [r["n"] for r in df.collect()] == [1, 1, 1, 1, 1]


def slow(spark, seconds=60):
    def run(batches):
        time.sleep(seconds)
        yield from batches

    return spark.range(4).mapInPandas(run, "id long")


def test_deadline_ends_jobs(spark):
    began = time.time()
    with pytest.raises(TimeoutError):
        runtime.within(spark, 1.0, lambda: slow(spark).count())
    event = threading.Event()
    threading.Timer(1.0, event.set).start()
    with pytest.raises(runtime.Cancelled):
        runtime.within(spark, 50, lambda: slow(spark).count(), event)
    assert time.time() - began < 30
    assert runtime.within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        runtime.within(spark, 60, lambda: 1 / 0)


CASES = "id string, question string"


def test_log_goes_on_where_it_was_killed(spark):
    log = ResultLog(spark, tempfile.mkdtemp(prefix="spark-") + "/log")
    cases = spark.createDataFrame([(f"c{i}", f"q{i}") for i in range(40)], CASES)
    calls = []

    def work(mine, fail=False):
        calls.append(1)
        if fail and len(calls) == 3:
            raise KeyboardInterrupt
        return mine.select("id", F.when(F.col("id") == "c7", "error").otherwise("ok").alias("status"), F.upper("question").alias("answer"))

    with pytest.raises(KeyboardInterrupt):
        runtime.evaluate(cases, lambda m: work(m, True), log, pieces=5)
    schema = "id string, status string, answer string, error string"
    done = {r["id"] for r in log.rows(schema).collect()}
    assert 0 < len(done) < 40
    os.makedirs(f"{log.path}/attempt=000001/piece=000004")  # a piece that was cut short
    with open(f"{log.path}/attempt=000001/piece=000004/part-0.json", "w") as f:
        f.write('{"id": "c1", "status": "ok"')
    assert runtime.evaluate(cases, work, log, pieces=5) == 5
    rows = log.rows(schema).collect()
    assert sorted(r["id"] for r in rows) == sorted(f"c{i}" for i in range(40))
    assert {r["id"]: r["attempt"] for r in rows if r["id"] in done and r["id"] != "c7"} == {i: 1 for i in done - {"c7"}}
    assert [r["id"] for r in log.pending(cases).collect()] == ["c7"]
    assert runtime.evaluate(cases, lambda m: work(m).withColumn("status", F.lit("ok")), log, pieces=2) == 2
    assert log.pending(cases).count() == 0 and len(log.rows(schema).collect()) == 40


def test_log_past_its_deadline(spark):
    log = ResultLog(spark, tempfile.mkdtemp(prefix="spark-") + "/log")
    cases = spark.createDataFrame([(f"c{i}", "q") for i in range(10)], CASES)
    assert runtime.evaluate(cases, lambda m: slow(spark).selectExpr("'x' AS id", "'ok' AS status"), log, pieces=3, seconds=1.0) == 0
    rows = log.rows("id string, status string, error string").collect()
    assert {r["id"] for r in rows} == {f"c{i}" for i in range(10)} and {r["status"] for r in rows} == {"timeout"}
    assert runtime.evaluate(cases, lambda m: m.select("id", F.lit("ok").alias("status")), log, pieces=3) == 3
    assert {r["status"] for r in log.rows("id string, status string").collect()} == {"ok"}


def test_memory_over_a_restart(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    rows = context.exchanges(spark.read.parquet(f"{DATA}/conversations.parquet")).select("conv_id", F.col("turn").cast("long").alias("turn"), "question", "answer")
    want = {r["conv_id"]: r["history"] for r in context.history(rows).collect()}
    schema = rows.schema
    parts = [rows.where(F.col("turn") <= 3), rows.where((F.col("turn") > 3) & (F.col("turn") <= 7)), rows.where((F.col("turn") > 7) | (F.col("turn") == 1))]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{base}/in/{i}")
        # Each piece is a run of its own: the state comes from the checkpoint.
        stream = memory.remember(spark.readStream.schema(schema).parquet(f"{base}/in/*"))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("conv_id").agg(F.max_by("history", "turn").alias("history"))
    assert {r["conv_id"]: r["history"] for r in last.collect()} == want


def test_memory_forgets(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    schema = "conv_id long, turn long, question string, answer string, ts timestamp"
    batches = [[(1, 1, "a", "b", "2024-01-01 00:00"), (2, 1, "c", "d", "2024-01-01 00:30")], [(2, 2, "e", "f", "2024-01-01 01:15")], [(1, 2, "g", "h", "2024-01-01 01:20"), (2, 3, "i", "j", "2024-01-01 01:20")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{base}/in/{i}")
        stream = memory.remember(spark.readStream.schema(schema).parquet(f"{base}/in/*"), time="ts", expiry="1 hour")
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    got = {(r["conv_id"], r["turn"]): r["history"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got[(1, 2)] == "Q: g\nA: h"  # an hour and more after its last exchange, the first conversation was forgotten
    assert got[(2, 3)] == "Q: c\nA: d\nQ: e\nA: f\nQ: i\nA: j"
