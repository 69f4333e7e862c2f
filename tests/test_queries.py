"""All registered queries with a SQL twin against DuckDB, and the entry point."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from inkwell.plans.all_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    try:
        return f"{float(v):.5f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    rows = lambda d: sorted(str(tuple(map(plain, r))) for r in d[columns].itertuples(index=False))
    assert rows(want) == rows(got)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
