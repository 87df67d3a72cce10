"""Every registered query of the library's own operators equals its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests_support import TABLES, normal

OWN = {n for g in entry.GROUPS for n in g.queries}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_own_query_has_sql():
    assert set(entry.oracle_sql()) >= OWN
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    done = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in done.description]
    assert sorted(theirs) == columns
    assert ours == sorted((tuple(normal(r[theirs.index(c)]) for c in columns) for r in done.fetchall()), key=repr)


def test_flagship(spark):
    rows = entry.entry(spark).groupBy("status").count().collect()
    assert {r["status"] for r in rows} == {"added", "removed", "changed", "same"}
