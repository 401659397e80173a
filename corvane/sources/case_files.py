"""Cases and feedback in files: JSON lines with the last of an id winning, and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_question
from .workspace import shared_folder, stored

CASE = "id string, question string, expected_articles array<string>, reference_answer string, category string, difficulty string, question_type string, citation_type string, language string, notes string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Valid lines with an id; a later line replaces an earlier one in its place."""
    raw = spark.read.schema(CASE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    lines = raw.withColumn("_line", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())).where("_bad is null and nullif(id, '') is not null").drop("_bad")
    return last_wins(lines, "id", "_line")


def last_wins(rows: DataFrame, key: str, line: str) -> DataFrame:
    """(…, pos): the last row of each key, where its first one stood."""
    others = [c for c in rows.columns if c not in (key, line)]
    grouped = rows.groupBy(key).agg(F.min(line).alias("pos"), F.max_by(F.struct(*others), line).alias("m"))
    return grouped.select(key, *(F.col(f"m.{c}").alias(c) for c in others), "pos")


def append_cases(old: DataFrame, new: DataFrame) -> DataFrame:
    """New cases whose question isn't there yet, numbered on from the old ones' greatest number."""
    key = normalise_question(F.col("question"))
    valid = new.where("nullif(trim(question), '') is not null and size(expected_articles) > 0")
    first = valid.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*new.columns), F.struct(*new.columns)).alias("m")).select("_k", "m.*")
    fresh = first.join(old.select(key.alias("_k")), "_k", "left_anti")
    last = old.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("int")), F.lit(0)).alias("last"))
    numbered = numbered_in_order(fresh, "_k").join(F.broadcast(last))
    return numbered.withColumn("id", F.format_string("case_%03d", F.col("_n") + F.col("last"))).drop("_k", "_n", "last")


def numbered_in_order(rows: DataFrame, key: str) -> DataFrame:
    """The rows with ``_n``, from 1 in order of a unique key: numbers within ranges of the key, behind the rows of all ranges before."""
    dealt = rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, shared_folder(rows.sparkSession, "numbered"))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_c"))
    # A row for each range: as many as there are partitions.
    before = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).cast("int").alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return dealt.join(F.broadcast(before), "_range").withColumn("_n", within + F.col("_before")).drop("_range", "_before")


def pending(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases without a result of status ok; failed ones are tried again."""
    return cases.join(results.where("status = 'ok'").select("id").distinct(), "id", "left_anti")


def id_counts(results: DataFrame, line: str) -> DataFrame:
    """(cases, ok, error): distinct ids, by the status of each id's first line; a line without a status failed."""
    first = results.where("id is not null").groupBy("id").agg(F.min_by(F.coalesce("status", F.lit("error")), line).alias("status"))
    return first.agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("error"))


def chosen_cases(cases: DataFrame, ids: list[str] | None = None, limit: int | None = None, **equal: str) -> DataFrame:
    """Cases with one of the ids, with these values of their columns in any case, and of these the first ones in the file's order."""
    for column, value in equal.items():
        cases = cases.where(F.lower(column) == value.lower())
    if ids is not None:
        cases = cases.where(F.col("id").isin(ids))
    return cases if limit is None else cases.orderBy("pos").limit(limit)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """(case, section, body) of Markdown files: sections by their ``## `` headings."""
    # A case's name is in its file's, or else in its folder's.
    name = F.coalesce(*(F.nullif(F.regexp_extract(f"_metadata.{c}", r"(case_\d+)[^/]*" + end, 1), F.lit("")) for c, end in (("file_name", "$"), ("file_path", r"/[^/]*$"))), F.lit(""))
    files = spark.read.text(path, wholetext=True).select(name.alias("case"), "value")
    parts = F.slice(F.split("value", r"(?m)^## "), 2, 1000)
    return files.select("case", F.posexplode(parts).alias("pos", "p")).select("case", F.trim(F.substring_index("p", "\n", 1)).alias("section"), F.regexp_replace(F.expr("substring(p, instr(p, chr(10)) + 1)"), r"^\s+|\s+$", "").alias("body"))


def write_feedback(sections: DataFrame, path: str) -> None:
    """Markdown files of (case, pos, section, body) rows, a folder for each case: what ``read_feedback`` reads back."""
    part = F.concat(F.lit("## "), "section", F.lit("\n"), "body", F.lit("\n"))
    rows = sections.groupBy("case").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("s")))), lambda r: r["s"]), "\n").alias("s"))
    text = rows.select("case", F.concat(F.lit("# "), "case", F.lit("\n\n"), "s").alias("value"))
    text.repartition("case").write.mode("overwrite").partitionBy("case").text(path)


def next_case(spark: SparkSession, names: DataFrame) -> DataFrame:
    """One number on from the greatest in (name)."""
    return names.agg((F.coalesce(F.max(F.regexp_extract("name", r"case_(\d+)", 1).cast("int")), F.lit(0)) + 1).alias("next"))
