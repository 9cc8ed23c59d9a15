"""Every registered query with oracle SQL gives the same rows as the SQL on the smallest tables."""

import pytest
from checker import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, spark, folder, con):
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) == []


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_one_row_per_candidate(spark, folder):
    rows = entry(spark).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/customer.parquet").count()
    assert all(0 <= r.avg_score <= 100 and r.overall_status in ("Verified", "Suspicious", "Fake") for r in rows)


def test_verified_documents_are_whole(spark, folder):
    rows = QUERIES["verify_documents"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert len({r.document_id for r in rows}) == len(rows)
    assert {r.status for r in rows} <= {"Verified", "Suspicious", "Fake"}
    assert all((r.status == "Fake") == (r.authenticity_score <= 30) for r in rows)
