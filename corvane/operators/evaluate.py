"""Metrics of ranked lists, sliced summaries, exclusive quantiles and run comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import article_family, normalise_article

METRICS = ("hit_at_1", "hit_at_1_family", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "precision_at_3", "precision_at_5")


def hit(got: Column, wanted: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(got, 1, k), wanted).cast("int")


def recall(got: Column, wanted: Column, k: int) -> Column:
    n = F.size(F.array_distinct(wanted))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(got, 1, k), wanted)) / n).otherwise(0.0)


def precision(got: Column, wanted: Column, k: int) -> Column:
    """Over k, even where fewer came back."""
    return F.size(F.filter(F.slice(got, 1, k), lambda a: F.array_contains(wanted, a))) / F.lit(k).cast("double")


def mrr(got: Column, wanted: Column) -> Column:
    ranks = F.filter(F.transform(got, lambda a, i: F.when(F.array_contains(wanted, a), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(ranks) > 0, F.lit(1.0) / F.get(ranks, F.lit(0))).otherwise(0.0)


def with_metrics(cases: DataFrame, suffix: str = "", got: str = "retrieved", wanted: str = "expected") -> DataFrame:
    """The rows with all metrics; both lists are normalised and made distinct in order first."""
    # Columns of their own: worked out once for all metrics, as expressions used more than once aren't merged into them.
    g, w = F.col("_got"), F.col("_wanted")
    listed = cases.withColumns({name: F.array_distinct(F.transform(c, normalise_article)) for name, c in (("_got", got), ("_wanted", wanted))})
    family = lambda c: F.transform(c, article_family)
    return listed.withColumns(
        {
            f"hit_at_1{suffix}": F.coalesce(hit(g, w, 1), F.lit(0)),
            f"hit_at_1_family{suffix}": F.coalesce(hit(family(g), family(w), 1), F.lit(0)),
            **{f"recall_at_{k}{suffix}": recall(g, w, k) for k in (1, 3, 5)},
            f"mrr{suffix}": mrr(g, w),
            **{f"precision_at_{k}{suffix}": precision(g, w, k) for k in (3, 5)},
        }
    ).drop("_got", "_wanted")


def with_expanded(cases: DataFrame) -> DataFrame:
    """Metrics of the ranked list, and of the list with expanded articles after it."""
    both = cases.withColumn("_all", F.concat("retrieved", "expanded"))
    return with_metrics(with_metrics(both), "_with_expanded", "_all").drop("_all", "hit_at_1_family_with_expanded", "precision_at_3_with_expanded", "precision_at_5_with_expanded")


def sliced_summary(cases: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """(dim, slice, metric, value, n) over all rows with status ok, and by each dimension: one pass, one shuffle."""
    ok = cases.where("status = 'ok'")
    tall = ok.select(F.explode(F.array(F.struct(F.lit("overall").alias("dim"), F.lit("all").alias("slice")), *(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("slice")) for d in dims))).alias("g"), *metrics)
    per = tall.groupBy("g.dim", "g.slice").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))
    return per.unpivot(["dim", "slice", "n"], metrics, "metric", "value").select("dim", "slice", "metric", "value", "n")


def with_empty_slices(summary: DataFrame, spine: DataFrame) -> DataFrame:
    """Slices without rows too, with n = 0 and no value."""
    return spine.join(summary, ["dim", "slice", "metric"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Quantile, in hundredths, and the least number of values it is given for.
QUANTILES = ((50, 2), (90, 10), (99, 100))
CUTS = [i / 64 for i in range(1, 64)]


def latency_quantiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """p50, p90 and p99 by group after the exclusive (n + 1) rule, exactly; NULL for too few values.

    Approximate cut points split each group into buckets, whose counts tell in
    which of them the wanted order statistics lie; only equal values' counts of
    those buckets are put in order. No task holds a whole group.
    """
    rows = rows.select(key, F.col(value).cast("double").alias("v")).where("v is not null")
    cuts = rows.groupBy(key).agg(F.percentile_approx("v", F.array(*map(F.lit, CUTS)), F.lit(1000)).alias("cuts"), F.count("*").alias("n"))
    bucketed = rows.join(cuts.select(key, "cuts"), key).select(key, F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"), "v")
    ties = bucketed.groupBy(key, "bucket", "v").agg(F.count("*").alias("c"))
    sizes = ties.groupBy(key, "bucket").agg(F.sum("c").alias("c"))
    # At most 64 rows to a group from here on.
    below = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.select(key, "bucket", F.coalesce(F.sum("c").over(below), F.lit(0)).alias("before"), "c")
    place = lambda q: F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * q / F.lit(100)), F.col("n") - 1)).cast("long")
    wanted = cuts.select(key, "n", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), (place(q) + i).alias("at"), F.lit(i).alias("i"), ((F.col("n") + 1) * q - place(q) * 100).alias("delta")) for q, _ in QUANTILES for i in (0, 1)))).alias("w")).select(key, "n", "w.*")
    located = wanted.join(spans, key).where("at > before and at <= before + c").select(key, "bucket", "n", "q", "i", "delta", (F.col("at") - F.col("before")).alias("within"))
    upto = Window.partitionBy(key, "bucket").orderBy("v")
    ordered = ties.join(located.select(key, "bucket").distinct(), [key, "bucket"], "left_semi").select(key, "bucket", "v", "c", F.sum("c").over(upto).alias("upto"))
    found = located.join(ordered, [key, "bucket"]).where("within > upto - c and within <= upto")
    part = F.col("v") * F.when(F.col("i") == 0, 100 - F.col("delta")).otherwise(F.col("delta"))
    value_of = lambda q, least: F.when(F.max("n") >= least, F.sum(F.when(F.col("q") == q, part)) / 100.0).alias(f"p{q}")
    return found.groupBy(key).agg(F.max("n").alias("n"), *(value_of(q, least) for q, least in QUANTILES))


def compare_runs(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """B minus A for each (dim, slice, metric), with what it means."""
    key = ["dim", "slice", "metric"]
    both = a.select(*key, F.col("value").alias("value_a")).join(b.select(*key, F.col("value").alias("value_b")), key, "full")
    delta = F.round(F.col("value_b") - F.col("value_a"), 4)
    verdict = F.when(F.col("value_a").isNull(), "only in B").when(F.col("value_b").isNull(), "only in A").when(delta < -tolerance, "regression").when(delta > tolerance, "improvement").otherwise("same")
    return both.withColumns({"delta": delta, "verdict": verdict})


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("key", F.col("value").alias("value_a")).join(b.select("key", F.col("value").alias("value_b")), "key", "full")
    return both.where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def review_counts(flags: DataFrame) -> DataFrame:
    """Rows, cases and severe ones by check and category."""
    return flags.groupBy("check", "category").agg(F.count("*").alias("n"), F.count_distinct("id").alias("cases"), F.count_if(F.col("severity").isin("high", "medium")).alias("serious"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 25) -> DataFrame:
    return rows.where(f"{value} between {low} and {high}").groupBy(F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def heat_map(rows: DataFrame, row: str, col: str, cols: list[str], value: str, least: int = 2) -> DataFrame:
    """Mean by two dimensions; cells of fewer than ``least`` rows are empty."""
    cell = F.when(F.count(value) >= least, F.avg(value))
    return rows.groupBy(row).pivot(col, cols).agg(cell)


def any_flag(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)
