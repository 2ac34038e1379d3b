"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import compare
from logscope.plans.catalog import QUERIES
from logscope.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for table in ("events", "documents"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    result = compare(spark, db, SF, name)
    assert result.startswith("ok" if name in ORACLES else "rows-only"), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
