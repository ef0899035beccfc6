"""Every query with an SQL twin against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pagewright.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(d: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return sorted(tuple(cell(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got.columns) > 0
