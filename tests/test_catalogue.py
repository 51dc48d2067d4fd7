"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrand.jobs import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple("null" if x is None else repr(float(x)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    mine = canonical(tuple(r[c] for c in columns) for r in found.collect())
    assert len(set(found.columns)) == len(columns)
    if name not in catalogue.ORACLE_SQL:
        assert mine
        return
    said = sql.sql(catalogue.ORACLE_SQL[name])
    assert sorted(said.columns) == columns
    assert mine == canonical(said.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry_and_names():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
