"""Text queries that SQL can express, against DuckDB."""

import os

import pytest

from glimmer.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        p = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = registry.queries()[name](spark, DIR)
    cursor = con.execute(registry.oracles()[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(got.columns)
    assert order == sorted(columns)
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([r[columns.index(c)] for c in order]) for r in cursor.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 14))
