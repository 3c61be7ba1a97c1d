"""The SQL of this subpackage's queries against the queries."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, found.fetchall()))
