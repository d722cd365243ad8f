"""Every registered query of the graph engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from quadrille.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted([tuple(clean(r[i]) for i in at) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == norm(cur.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["hash", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
