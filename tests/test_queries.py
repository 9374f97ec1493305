"""Every registered query against the SQL it is declared equal to, on the smallest tables."""

from __future__ import annotations

import decimal

import pytest

import __spark_entry__ as entry
from tableproof import registry
from tableproof.fixtures import TABLES

duckdb = pytest.importorskip("duckdb")

QUERIES, ORACLE = registry.QUERIES, registry.ORACLE


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value) if not isinstance(value, decimal.Decimal) else format(value, "f")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = oracle.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    rows = {r["table"]: r["status"] for r in entry.entry(spark).collect()}
    changed = {"orders": "DIFFERS", "pages": "DIFFERS", "conversations": "DIFFERS", "labels": "ABSENT", "ghost": "EXTRA"}
    assert rows == {**{t: "OK" for t in TABLES}, **changed}
