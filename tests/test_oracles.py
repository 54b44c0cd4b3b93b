"""Every narration query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from lectern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return v


def test_names_match(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 80


def test_all_queries(spark, sf, duck):
    sql, wrong = registry.oracle_sql(), []
    for name, query in registry.queries().items():
        df = query(spark, sf)
        columns = sorted(df.columns)
        got = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
        if name not in sql:
            continue
        found = duck.sql(sql[name])
        assert sorted(found.columns) == columns, name
        at = [found.columns.index(c) for c in columns]
        expected = sorted(repr([norm(r[i]) for i in at]) for r in found.fetchall())
        if got != expected:
            wrong.append(name)
    assert not wrong
