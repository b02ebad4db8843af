"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from webkb.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or value != value:
        return "null"
    return str(round(value, 9)) if isinstance(value, float) else str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(shown(r[i]) for i in order) for r in rows])


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted_rows(df.columns, rows) == sorted_rows(columns, got.fetchall())


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
