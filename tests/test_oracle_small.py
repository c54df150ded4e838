"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ["orders", "customer", "lineitem", "part", "documents", "conversations"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, Decimal)):
        return repr(float(v))
    return str(v)


def _rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple("" if x is None else x for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    yield con
    con.close()


def _names():
    import __spark_entry__ as entry

    return sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF_SMALL)
    s_names, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    d_names, d_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_names) == sorted(d_names)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_names, s_rows) == _rows(d_names, d_rows)
