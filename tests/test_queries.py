"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import catalog
from tessera.sources import stages

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, str):
        return value
    if hasattr(value, "__iter__"):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, bool | np.bool_):
        return str(bool(value))
    return f"{float(value):.5f}".replace("-0.00000", "0.00000")


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    before = {*stages._made}
    with stages.scope(spark):
        got = catalog.queries()[name](spark, SF).toPandas()
    assert {*stages._made} - before <= stages._shared  # what a query stored is gone, but for what a session keeps
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
