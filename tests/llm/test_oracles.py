"""The corpus queries with SQL twins, against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from loanrisk.llm import catalog
from tests.conftest import SMALL


def canon(df):
    """Rows by sorted column names; a missing number is None in both engines."""
    cols = sorted(df.columns)

    def norm(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return v + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return cols, sorted((tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL, t)}.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert canon(catalog.QUERIES[name](spark, SMALL).toPandas()) == canon(want)
