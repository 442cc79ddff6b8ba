"""The corpus operators' SQL against their queries on the smallest tables."""

import os

import pytest

from tessera.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = c.execute(registry.ORACLES[name])
    order = [d[0] for d in got.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(order)
    plain = lambda rows: sorted(tuple("~" if x is None else str(x) for x in r) for r in rows)
    assert plain(df.select(order).collect()) == plain(got.fetchall())
