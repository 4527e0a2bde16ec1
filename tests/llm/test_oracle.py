"""The queries with SQL against DuckDB, and all queries for one row per document."""

import os

import pytest

from auditlake.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import DATA, by_duckdb, by_spark

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert by_spark(QUERIES[name](spark, DATA)) == by_duckdb(ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_per_document(spark, name):
    found = QUERIES[name](spark, DATA)
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in documents.select("doc_id").collect())
