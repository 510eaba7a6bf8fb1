"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import duckdb
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    rows = registry.QUERIES[name](spark, SF)
    got = rows.collect()
    ran = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in ran.description]
    assert sorted(rows.columns) == sorted(columns)
    at = [columns.index(c) for c in sorted(columns)]
    want = sorted((repr([plain(r[i]) for i in at]) for r in ran.fetchall()))
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in got) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
