"""The corpus queries that have SQL, against it."""

import duckdb
import pytest

from quadrille.llm import entry_queries
from tests.test_oracles import TABLES, norm

SQL = entry_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry_queries.queries()[name](spark, sf)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), names)
