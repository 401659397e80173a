"""A keyed table whose upserts and patches rewrite only the buckets that they change.

Rows are dealt to buckets by a hash of their key, and within a bucket to folders by
the columns that scans filter on. A version is a manifest that names, for each
bucket, the write its files are from: an upsert or a patch writes the changed
buckets beside the old ones and switches the manifest in one step. Untouched
buckets keep their files, readers always find a whole table, and a DataFrame made
before a switch still reads the version it was made on, until ``vacuum``.

Defined results: of a batch's rows with one key the greatest counts; rows without a
key are an error; columns that only the batch or only the table has are null
elsewhere; an upsert or patch without rows makes no version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Conflict, Files, Versions, stored

BUCKET = "_bucket"


@dataclass
class BucketTable:
    """The table at a path."""

    spark: SparkSession
    path: str

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return bool(Versions(spark, path).current()[0])

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, buckets: int, partitions: tuple[str, ...] = ()) -> BucketTable:
        """A new first version, or one that replaces all rows of the table that is there."""
        table = BucketTable(rows.sparkSession, path)
        seen, _ = table._versions.current()
        layout = {"key": key, "buckets": buckets, "partitions": list(partitions)}
        write = table._write(table._keyed(_greatest(rows, key), layout), layout)
        table._versions.switch(seen, {**layout, "schema": rows.schema.json(), "writes": {str(b): write for b in table._buckets_of(write)}})
        return table

    @property
    def _versions(self) -> Versions:
        return Versions(self.spark, self.path)

    def version(self) -> int:
        return self._versions.current()[0]

    def _keyed(self, rows: DataFrame, layout: dict) -> DataFrame:
        key = F.when(F.col(layout["key"]).isNull(), F.raise_error(F.lit("a row without a key"))).otherwise(F.xxhash64(F.col(layout["key"])))
        return rows.withColumn(BUCKET, F.pmod(key, F.lit(layout["buckets"])).cast("int"))

    def _write(self, keyed: DataFrame, layout: dict) -> str:
        write = f"write={uuid.uuid4().hex}"
        keyed.repartition(BUCKET, *layout["partitions"]).write.partitionBy(BUCKET, *layout["partitions"]).parquet(f"{self.path}/data/{write}")
        return write

    def _buckets_of(self, write: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in Files(self.spark, f"{self.path}/data").names(write) if n.startswith(f"{BUCKET}="))

    def _scan(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The version's rows, of these buckets or all."""
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.path}/data/{w}/{BUCKET}={b}" for b, w in manifest["writes"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema, T.StructField("write", T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    def scan(self, version: int | None = None, **equal: str) -> DataFrame:
        """All rows, or those with these values; the current version, or an older one that is still there."""
        manifest = self._versions.current()[1] if version is None else self._versions.at(version)
        df = self._scan(manifest)
        for column, value in equal.items():
            df = df.where(F.col(column) == value)
        return df

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        _, manifest = self._versions.current()
        key = manifest["key"]
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(key, T.StructType.fromJson(json.loads(manifest["schema"]))[key].dataType)]))
        buckets = [r[0] for r in self._keyed(asked, manifest).select(BUCKET).distinct().collect()]
        return self._scan(manifest, buckets).where(F.col(key).isin(keys))

    def _put(self, seen: int, manifest: dict, rows: DataFrame, changed: list[int]) -> int:
        """Switch to a version whose changed buckets hold these rows and nothing else."""
        write = self._write(self._keyed(rows, manifest), manifest)
        left = {b: w for b, w in manifest["writes"].items() if int(b) not in changed}
        return self._versions.switch(seen, {**manifest, "schema": rows.schema.json(), "writes": left | {str(b): write for b in self._buckets_of(write)}})

    def upsert(self, batch: DataFrame, tries: int = 5) -> int:
        """Put the batch's rows in the place of those with their keys; the version that has them."""
        for _ in range(tries):
            seen, manifest = self._versions.current()
            key = manifest["key"]
            staged = f"_batch-{uuid.uuid4().hex}"
            fresh = stored(self._keyed(_greatest(batch, key), manifest), f"{self.path}/{staged}")
            try:
                changed = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
                if not changed:
                    return seen
                kept = self._scan(manifest, changed).join(fresh.select(key), key, "left_anti")
                return self._put(seen, manifest, kept.unionByName(fresh.drop(BUCKET), allowMissingColumns=True), changed)
            except Conflict:
                continue
            finally:
                Files(self.spark, self.path).delete(staged)
        raise Conflict(f"{tries} tries of an upsert met other writers")

    def patch(self, values: dict[str, Column], where: Column | None = None, tries: int = 5) -> tuple[int, int]:
        """Set columns in place; the version, and how many rows were changed. Buckets where no value changes keep their files.

        Values and condition may use all columns. A key can't be patched.
        """
        for _ in range(tries):
            seen, manifest = self._versions.current()
            if manifest["key"] in values:
                raise ValueError("a key can't be patched")
            rows = self._keyed(self._scan(manifest), manifest)
            differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(v) for c, v in values.items()))
            differs = differs & where if where is not None else differs
            counts = rows.where(differs).groupBy(BUCKET).count().collect()
            if not counts:
                return seen, 0
            changed = [r[BUCKET] for r in counts]
            old = self._scan(manifest, changed)
            patched = old.withColumns({c: F.when(where, v).otherwise(F.col(c)) if where is not None else v for c, v in values.items()})
            try:
                return self._put(seen, manifest, patched.select(*(F.col(f.name).cast(f.dataType) for f in old.schema)), changed), sum(r["count"] for r in counts)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries of a patch met other writers")

    def files(self) -> dict[str, int]:
        """Data files of the current version, with their sizes."""
        out: dict[str, int] = {}
        for b, w in self._versions.current()[1].get("writes", {}).items():
            out |= Files(self.spark, self.path).sizes(f"data/{w}/{BUCKET}={b}")
        return out

    def vacuum(self) -> None:
        """Delete what no bucket of the current version is in; nobody may be reading an older one."""
        used = self._versions.current()[1]["writes"]
        files = Files(self.spark, f"{self.path}/data")
        for write in files.names():
            for bucket in files.names(write):
                if bucket.startswith(f"{BUCKET}=") and used.get(bucket.split("=")[1]) != write:
                    files.delete(f"{write}/{bucket}")


def _greatest(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: the greatest, by the other columns in order; maps don't order and count by their entries."""
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    order = F.struct(*((F.array_sort(F.map_entries(c)) if isinstance(rows.schema[c].dataType, T.MapType) else F.col(c)).alias(c) for c in others))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_m"))
    return best.select(*(F.col(c) if c == key else F.col(f"_m.{c}").alias(c) for c in rows.columns))
