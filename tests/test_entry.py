import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries as engine

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in [*engine.TABLES, "pages", "conversations", "embeddings"]:
        c.execute(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", engine.queries())
def test_engine_query_agrees_with_sql(spark, duck, name):
    got = engine.queries()[name](spark, DIR)
    want = duck.execute(engine.oracle_sql()[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_contract(spark):
    assert set(engine.oracle_sql()) == set(engine.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["part_name", "first_date"] and entry.entry(spark).count() == 1
