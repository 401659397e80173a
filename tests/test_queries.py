"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from corvane import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return "%.9g" % v
    if hasattr(v, "tolist") and not isinstance(v, str):
        return plain(v.tolist())
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DATA, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_plans_push_and_limit(spark):
    plan = registry.queries()["cosine_topk"](spark, DATA)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = registry.queries()["resume_pending"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "LeftAnti" in plan
