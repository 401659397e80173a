"""Folders that all executors share, and tables whose versions are switched in one step.

A versioned table is a folder of data that is never written over, and numbered
manifests beside it. A manifest is written under another name and then given its
number by a rename that fails where the number is taken: readers see the version
before or the version after, and of two writers one has to begin again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has switched the table meanwhile."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; without that setting a temporary one, on one machine only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows as a written table: lineage ends there, lost executors cost nothing, and its size is known."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Files:
    """A folder on whatever file system Spark reads."""

    spark: SparkSession
    root: str

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def sizes(self, folder: str = "") -> dict[str, int]:
        """Names and bytes of all files under a folder."""
        path, fs = self._path(folder)
        out, found = {}, fs.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            out[f.getPath().toString()] = f.getLen()
        return out

    def delete(self, name: str = "") -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def read(self, name: str) -> str:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file as a whole, unless the name is taken; whether it was written."""
        (target, fs), (part, _) = self._path(name), self._path(f"_writing-{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # A local rename replaces its target, other file systems refuse: the number is taken first by a file that only one can create.
        claim, _ = self._path(f"{name}.claim")
        won = not fs.exists(target) and fs.createNewFile(claim) and fs.rename(part, target)
        if not won:
            fs.delete(part, False)
        return won


class Versions:
    """A versioned table's manifests, each a JSON object."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = Files(spark, path)

    def current(self) -> tuple[int, dict]:
        """The newest version and its manifest; 0 and nothing before the first."""
        numbers = [int(n[:-5]) for n in self.files.names("_versions") if n.endswith(".json")]
        return (max(numbers), json.loads(self.files.read(f"_versions/{max(numbers):012d}.json"))) if numbers else (0, {})

    def at(self, version: int) -> dict:
        """An older version's manifest."""
        return json.loads(self.files.read(f"_versions/{version:012d}.json"))

    def switch(self, seen: int, manifest: dict) -> int:
        """Make the manifest the version after ``seen``."""
        if not self.files.put_new(f"_versions/{seen + 1:012d}.json", json.dumps(manifest)):
            raise Conflict(f"version {seen + 1} of {self.files.root} is another writer's")
        return seen + 1
