"""Every registered query against its SQL counterpart at the smallest scale."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

from leadloom import plans
from leadloom.sources.fixtures import TABLES

plans.load()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf, duck):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.ORACLES:
        assert got
        return
    cur = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in order) for row in cur.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["lead_id", "search_id", "company_name", "domain", "quality_score", "verification_score", "signal_strength"]
    assert set(e.oracle_sql()) <= set(e.queries())
