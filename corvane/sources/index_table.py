"""The index's table: scans, upsert by key, patches and diagnostics.

With ``buckets`` it is a versioned table whose upserts and patches write only the
buckets they change (see ``bucket_table``); without, a plain folder of parquet
files that any reader can open, which an upsert writes whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bucket_table import BucketTable

PARTITIONS = ("language", "chunk_type")


def create(nodes: DataFrame, path: str, buckets: int | None = None, key: str = "key") -> None:
    """Replace the index; partitioned for the two filters that every retrieval has."""
    if buckets:
        BucketTable.create(nodes, path, key, buckets, PARTITIONS)
        return
    nodes.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)


def scan(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    """All rows with these values; partitions and row groups are skipped by them."""
    if BucketTable.exists(spark, path):
        return BucketTable(spark, path).scan(**equal)
    df = spark.read.parquet(path)
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df


def latest(rows: DataFrame, key: str, batch: str) -> DataFrame:
    """The row of each key's last batch, by a map-side combined maximum instead of a sort."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(batch, *(c for c in others if c != batch))).alias("m"))
    return best.select(key, *(F.col(f"m.{c}").alias(c) for c in others))


def upsert(spark: SparkSession, path: str, batch: DataFrame, key: str = "key") -> None:
    """Rows of the batch replace those with their key; the table is written beside and swapped in.

    Parquet has no merge: the new table is written whole, the old one set aside, the new one named, and only then the
    old one deleted; a swap that was cut short is undone first. Of a key's rows in a batch the greatest counts. A table
    with buckets has its changed buckets written and its version switched instead.
    """
    if BucketTable.exists(spark, path):
        BucketTable(spark, path).upsert(batch)
        return
    jvm = spark.sparkContext._jvm
    src, dst, aside = (jvm.org.apache.hadoop.fs.Path(f"{path}{x}") for x in ("__staged", "", "__old"))
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(dst) and fs.exists(aside):
        fs.rename(aside, dst)
    old = spark.read.parquet(path)
    kept = old.join(batch.select(key).distinct(), key, "left_anti")
    others = [c for c in batch.columns if c != key]
    fresh = batch.groupBy(key).agg(F.max(F.struct(*others)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in others))
    staged = f"{path}__staged"
    kept.unionByName(fresh, allowMissingColumns=True).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(staged)
    fs.delete(aside, True)
    if not (fs.rename(dst, aside) and fs.rename(src, dst)):
        raise OSError(f"could not put {staged} in the place of {path}")
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def patch(spark: SparkSession, path: str, values: dict[str, Column], where: Column | None = None) -> int:
    """Set columns of a table with buckets in place; how many rows changed."""
    return BucketTable(spark, path).patch(values, where)[1]


def changed(rows: DataFrame, column: str, new: Column) -> DataFrame:
    """Rows whose value would change, with old and new: the dry run of a patch."""
    return rows.withColumn("_new", new).where(~F.col(column).eqNullSafe(F.col("_new"))).withColumnsRenamed({column: "old", "_new": "new"})


def diagnostics(nodes: DataFrame) -> DataFrame:
    """Nodes, articles, annexes and surplus keys by language."""
    per_key = nodes.groupBy("language", "node_id").agg(F.count("*").alias("c"), F.first("level").alias("level"))
    return per_key.groupBy("language").agg(F.sum("c").alias("nodes"), F.count_if(F.col("level") == "ANNEX").alias("annexes"), F.count_if(F.col("c") > 1).alias("duplicate_keys"))


def difference(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys that only one side has."""
    both = parsed.select("node_id", F.lit(True).alias("p")).join(stored.select("node_id", F.lit(True).alias("s")), "node_id", "full")
    return both.where("p is null or s is null").select("node_id", F.when(F.col("p").isNull(), "index").otherwise("parser").alias("only_in"))


def text_or_blob(text: Column, blob: Column) -> Column:
    """The text, else the blob's, else empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.get_json_object(blob, "$.text"), F.lit(""))
