"""What an evaluation shows: coverage, reviews, errors, box figures, scorecards and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a value that a table doesn't have.
ABSENT = "—"


def uncovered(articles: DataFrame, cases: DataFrame) -> DataFrame:
    """The articles that no case expects."""
    covered = cases.select(F.explode("expected_articles").alias("article")).distinct()
    return articles.join(covered, "article", "left_anti")


def priority_articles(wanted: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """The first ``most`` wanted articles that the index has, by number and then suffix, with their title."""
    titles = index.where("article is not null").groupBy("article").agg(F.min("article_title").alias("title"))
    found = wanted.select("article").distinct().join(titles, "article")
    number = F.regexp_extract("article", r"^(\d+)", 1).try_cast("long")
    return found.orderBy(number.asc_nulls_last(), "article").limit(most)


def needs_review(flags: Column) -> Column:
    """Whether any flag is of high or medium severity; none without flags."""
    return F.coalesce(F.exists(flags, lambda f: f["severity"].isin("high", "medium")), F.lit(False))


def with_review(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each case with the status of its last review, by ``pos``; ``unreviewed`` without one."""
    last = reviews.groupBy("id").agg(F.max_by("status", F.struct("pos", "status")).alias("review"))
    return cases.join(last, "id", "left").withColumn("review", F.coalesce("review", F.lit("unreviewed")))


def error_breakdown(cases: DataFrame) -> DataFrame:
    """(error_type, n, sample) of cases that failed: how many of each type, and the least of its messages."""
    return cases.where("status <> 'ok' and error_type is not null").groupBy("error_type").agg(F.count("*").alias("n"), F.min("error_message").alias("sample"))


def box_figures(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, least, quartiles by linear interpolation, greatest and whiskers (within 1.5 spreads) by group.

    Values are counted before they are shuffled; a quartile's state is one count a distinct value, so that ``value`` ought
    to be a score of bounded precision.
    """
    ties = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    quartiles = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c"))
    box = ties.groupBy(key).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"), quartiles.alias("q"))
    spread = 1.5 * (F.col("q")[2] - F.col("q")[0])
    fences = box.select("*", (F.col("q")[0] - spread).alias("lo"), (F.col("q")[2] + spread).alias("hi"))
    # One row a group: met by the counted values, not by all rows.
    inside = ties.join(fences.select(key, "lo", "hi"), key).where("v between lo and hi").groupBy(key).agg(F.min("v").alias("whisker_low"), F.max("v").alias("whisker_high"))
    return fences.join(inside, key).select(key, "n", "least", *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)), "greatest", "whisker_low", "whisker_high")


def melted(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value): a row for each value that isn't null."""
    return rows.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value").where("value is not null")


def shown(value: Column, share: bool = True, signed: bool = False) -> Column:
    """A share as a percentage with one decimal, another score with three; a dash for none."""
    sign = "+" if signed else ""
    text = F.format_string(f"%{sign}.1f%%", value * 100) if share else F.format_string(f"%{sign}.3f", value)
    return F.when(value.isNotNull(), text).otherwise(ABSENT)


def breakdown(summary: DataFrame, shares: list[str], scores: list[str] = ()) -> DataFrame:
    """(dim, slice, n, and each metric as text) from (dim, slice, metric, value, n)."""
    wide = summary.groupBy("dim", "slice").pivot("metric", [*shares, *scores]).agg(F.first("value"))
    sizes = summary.groupBy("dim", "slice").agg(F.max("n").alias("n"))
    return wide.join(sizes, ["dim", "slice"]).select("dim", "slice", "n", *(shown(F.col(m)).alias(m) for m in shares), *(shown(F.col(m), False).alias(m) for m in scores))


def scorecard(a: DataFrame, b: DataFrame, scores: list[str] = ()) -> DataFrame:
    """(dim, slice, metric, n_a, n_b, a, b, delta) as text: here run A's value minus run B's."""
    key = ["dim", "slice", "metric"]
    both = a.select(*key, F.col("value").alias("va"), F.col("n").alias("n_a")).join(b.select(*key, F.col("value").alias("vb"), F.col("n").alias("n_b")), key, "full")
    score = F.col("metric").isin(*scores) if scores else F.lit(False)
    text = lambda v, signed=False: F.when(score, shown(v, False, signed)).otherwise(shown(v, True, signed))
    size = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(ABSENT)).alias(c)
    return both.select(*key, size("n_a"), size("n_b"), text(F.col("va")).alias("a"), text(F.col("vb")).alias("b"), text(F.col("va") - F.col("vb"), True).alias("delta"))
