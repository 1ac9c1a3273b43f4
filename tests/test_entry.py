import duckdb
import pytest

import __spark_entry__ as entry_module
from lattika.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(names, data):
    show = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[n]) for n in sorted(names)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [r.asDict() for r in df.collect()])
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows(rel.columns, [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()])


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_module.queries())
