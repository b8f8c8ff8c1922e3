"""Every query against its SQL, as rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from quirespark.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    rows = df.collect()
    assert rows, "a query without rows shows nothing"
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    a, b = Counter(plain(tuple(r)) for r in rows), Counter(plain(tuple(r[i] for i in at)) for r in want.fetchall())
    assert sum(a.values()) == sum(b.values())
    more, less = list((a - b).items())[:3], list((b - a).items())[:3]
    assert not more and not less, f"only Spark: {more}\nonly SQL: {less}"
