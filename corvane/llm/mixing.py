"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its share of the target size over its
number of documents. A document's uniform number comes from a seeded hash of
its id; the count is the Poisson quantile at it. Copies are exploded and sorted
globally by a second seeded hash. Only DataFrame functions are used.

Defined results: a null source is a source of its own, with weight key None; a
null ``doc_id`` hashes as the empty text; rows that share an id get the same
count; a source without rows gets nothing; an empty table gives no rows;
columns named as an output are replaced. A rate over MOST_RATE is dealt over
equal draws with a hash each; their sum has the same distribution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Greatest mean rate of one draw, as the first term of a greater one's distribution underflows: such rates are the sum of several draws.
MOST_RATE = 600.0
#: Sources whose rates are sent to all tasks at most; more are joined, with each source dealt over SALTS.
MOST_SENT, SALTS = 10_000, 64
SEED, TEMPERATURE = 17, 0.5


def _hash(digits: int, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(SEED)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, size: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, draws, rate of each) for the given weights, else for counts to the power ``temperature``."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    weighed = counts.select("source", "n", weight.alias("w"))
    total = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n") if size is None else F.lit(size)
    # One row on the right.
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * wanted / F.col("n")).otherwise(0.0)
    whole = weighed.join(F.broadcast(total)).select("source", rate.alias("all_draws"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("all_draws") / MOST_RATE)).cast("int")
    return whole.select("source", draws.alias("draws"), (F.col("all_draws") / draws).alias("rate"))


def _steps() -> Column:
    """The distribution function at 0, 1, 2 ... as far as doubles tell it from one."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    start = F.struct(F.exp(-F.col("rate")).alias("p"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("rate") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def replicate(spark: SparkSession, docs: DataFrame, weights: dict[str | None, float] | None = None, size: int | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with copies, copy and shuffle_key, in global order of the key."""
    docs = docs.drop("copies", "copy", "shuffle_key", "_cdf", "_draws")
    scratch = Scratch(spark, "mixing")
    table = scratch.cut(rates(docs, weights, size).select("source", F.col("draws").alias("_draws"), _steps().alias("_cdf")), "rates").withColumnRenamed("source", "_source")
    few = table.limit(MOST_SENT + 1).count() <= MOST_SENT
    if few:
        joined = docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")))
    else:
        dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt"))).drop("_own", "_salt")
    uniform = lambda *draw: (_hash(13, F.col("doc_id"), *draw) + F.lit(0.5)) / F.lit(float(1 << 52))
    below = lambda u: F.size(F.filter("_cdf", lambda c: c < u))
    more = F.aggregate(F.sequence(F.lit(1), F.col("_draws") - 1), F.lit(0), lambda n, j: n + below(uniform(F.lit("draw"), j)))
    drawn = joined.withColumn("_u", uniform()).withColumn("copies", below(F.col("_u")) + F.when(F.col("_draws") > 1, more).otherwise(0))
    copies = drawn.drop("_cdf", "_draws", "_source", "_u").where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.withColumn("shuffle_key", _hash(15, F.col("doc_id"), F.col("copy"))).orderBy("shuffle_key", "doc_id", "copy")


def oracle() -> str:
    """The same draws in SQL, with the distribution from logarithms of its terms."""
    terms = "exp(-rate + k * ln(rate) - lgamma(k + 1.0))"
    return f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, pow(n::DOUBLE, {TEMPERATURE}) AS w FROM counts),
whole AS (SELECT source, w / (SELECT sum(w) FROM weighed) * (SELECT sum(n) FROM weighed) / n AS all_draws FROM weighed),
rates AS (SELECT source, greatest(1, ceil(all_draws / {MOST_RATE}))::INTEGER AS draws, all_draws / greatest(1, ceil(all_draws / {MOST_RATE})) AS rate FROM whole),
ks AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates),
cdf AS (SELECT source, k, sum({terms}) OVER (PARTITION BY source ORDER BY k) AS c FROM ks),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
dealt AS (SELECT r, d.doc_id, d.source, d.text, unnest(range(0, draws)) AS j FROM numbered d JOIN rates s ON s.source IS NOT DISTINCT FROM d.source),
drawn AS (SELECT r, source, (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || CASE WHEN j > 0 THEN '|draw|' || j ELSE '' END), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM dealt),
counted AS (SELECT d.r, count(*) FILTER (WHERE c.c < d.u) AS copies FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source GROUP BY d.r),
copies AS (SELECT doc_id, source, text, copies::INTEGER AS copies, unnest(range(1, copies + 1))::INTEGER AS copy FROM (SELECT d.*, c.copies FROM dealt d JOIN counted c USING (r) WHERE d.j = 0) WHERE copies > 0)
SELECT doc_id, source, text, copies, copy, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 15))::BIGINT AS shuffle_key FROM copies
"""


def expected_size(n: dict[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Expected copies by source, for tests."""
    w = {s: math.pow(k, temperature) for s, k in n.items()}
    return {s: w[s] / sum(w.values()) * sum(n.values()) for s in n}
