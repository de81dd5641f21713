"""Every registered query against its DuckDB oracle at sf0.001 (same compare as the
driver: columns sorted by name, rows as a multiset, floats to 9 places)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

from prioscope.plans.oracle import oracle_sql
from prioscope.plans.queries import QUERIES

SQL = oracle_sql()
TABLES = ["orders", "events", "documents", "customer", "lineitem"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_registered_with_oracle():
    missing = set(QUERIES) - set(SQL)
    assert missing == set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    s_cols, s_rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[name])
    d_cols, d_rows = _canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() >= 0 and "mismatch_type" in out.columns
