"""Queries that SQL can express, against it."""

import duckdb
import pytest

from codequarry.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted((dict(zip(columns, r)) for r in result.fetchall()), key=lambda r: str(sorted(r.items())))
    got = sorted((r.asDict() for r in df.collect()), key=lambda r: str(sorted(r.items())))
    assert sorted(columns) == sorted(df.columns) and got == want
