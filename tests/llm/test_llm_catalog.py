"""The registered queries: names, SQL twins and the pipeline."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check_oracles import compare
from shelfmark.llm import catalog

SF_DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not here")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert {*catalog.QUERIES, "pipeline"} <= set(contract.queries())
    assert set(catalog.SQL) <= set(catalog.QUERIES)


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_twin(spark, name):
    assert compare(spark, SF_DIR, [name]) == []


@needs_tables
def test_pipeline_composes_the_stages(spark):
    """On a thousand documents; two hundred hold too few labels to learn from."""
    got = corpus_pipeline.run(spark, LARGER)
    rows = {r.doc_id: r for r in got.collect()}
    docs = {r[0]: r for r in duckdb.sql(f"SELECT doc_id, text FROM '{LARGER}/documents.parquet'").fetchall()}
    toxic = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{LARGER}/labels.parquet' WHERE toxic = 1").fetchall()}
    assert set(rows) <= set(docs) and len(rows) > 0.6 * len(docs)
    assert len(set(rows) & toxic) < 0.4 * len(toxic)
    assert all(r.repeats in (1, 2) for r in rows.values())
    assert not any("@mail" in (r.text or "") for r in rows.values())
