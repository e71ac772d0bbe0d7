"""Every registered graph query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from arborq.plans import catalog, deep

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if pd.isna(x):
        return "~"
    if isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer():
        return str(int(x))
    return {"True": "true", "False": "false"}.get(str(x), str(x))


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


QUERIES, SQL = catalog.QUERIES | deep.QUERIES, catalog.SQL | deep.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")
def test_query(spark, db, name):
    got = QUERIES[name](spark, TABLES).toPandas()
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)
