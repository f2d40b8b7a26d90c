"""Every registered query against its SQL twin on the smallest sample tables."""

import os

import pytest

from __spark_entry__ import LLM_QUERIES, entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not here")


def test_every_query_has_sql_or_a_reason():
    assert set(queries()) - set(oracle_sql()) - set(LLM_QUERIES) == WITHOUT_SQL
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert {"doc_id", "display_name", "hit_number", "snippet"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(LLM_QUERIES)))
def test_query(spark, name):
    from check_oracles import compare
    assert compare(spark, SF_DIR, [name]) == []
