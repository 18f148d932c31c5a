"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_file
from corpusloom.checks.oracle import ORACLE
from corpusloom.checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# These take their result from a query that is checked here too.
REPEATED = {"dry_run", "discovered_small_budget", "rest_status", "corpus_index"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry_file.oracle_sql()) <= set(entry_file.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - REPEATED))
def test_query_equals_sql(spark, duck, name):
    result = entry_file.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry_file.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in result.select(*columns).collect()) == want
    assert want


def test_entry(spark):
    flagship = entry_file.entry(spark)
    assert flagship.columns == ["site", "section", "ord", "line"] and flagship.count() > 0
