"""Registered queries: each operator on the driver's tables, beside SQL that gives the same rows.

Inputs are SQL texts that mean the same in Spark and in DuckDB; ``{table}``
stands for a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.workspace import shared_folder


def rel(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SQL text over the tables' parquet files; nothing is put into the catalogue."""
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


_STORED: dict[tuple[str, str, str], object] = {}


def stored_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> object:
    """An index over the folder's tables: built when a session first asks for it, and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build(shared_folder(spark, name))
    return _STORED[key]


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan whose rows take long, over all cores: a table of few files is few tasks, one of many stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
