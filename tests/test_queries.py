"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillstone import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(df):
    return sorted(tuple(None if v != v else v for v in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)) if len(df) else []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    want = duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(_rows(got.astype(str))) == key(_rows(want.astype(str)))
