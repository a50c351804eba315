"""Every registered query against its SQL, on the sample tables, in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from tests.conftest import SF_DIR

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES = entry_point.registry.queries()
ORACLE = entry_point.oracle.oracle_sql()
# Lists that are right to be empty on the sample.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None:
            return "null"
        return repr(x + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = canonical(cursor.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert got == want
    assert got or name in MAY_BE_EMPTY


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
