"""Registered queries vs their DuckDB twins on the smallest test tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

# The loan queries; the corpus queries have their own test beside their operators.
QUERIES = [n for n, (_fn, sql) in E._registry().items() if sql]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["orders", "customer", "lineitem"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL, t)}.parquet')")
    return c


def canon(df):
    cols = sorted(df.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "isoformat"):
            return str(v)
        if hasattr(v, "item"):
            return norm(v.item())
        return v + 0.0 if isinstance(v, float) else v

    rows = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                "MapInPandas", "FlatMapCoGroupsInPandas", "AggregateInPandas")


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES), plan
    got = df.toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert canon(got) == canon(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) == 48 and df.count() > 0
