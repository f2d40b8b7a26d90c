"""Shapes of the physical plans that keep large tables cheap."""

import os
import random
import re

import numpy as np
import pytest
from helpers import doc, library, pages
from pyspark.sql import functions as F

from __spark_entry__ import LLM_QUERIES, queries
from shelfmark.operators import library as lib
from shelfmark.operators import pages as page_ops
from shelfmark.operators import search
from shelfmark.operators.oplog import operation_report
from shelfmark.plans.ranking import with_running_count

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    rows = [doc(i, f"d{i}", owner=f"o{i % 2}", favorite=i % 2 == 0) for i in range(20)]
    library(spark, *rows).write.parquet(str(root / "library"))
    text = [(i, j, "some text", [(0, 1, 2, 3)] * 9) for i in range(5) for j in range(3)]
    pages(spark, *text).write.parquet(str(root / "pages"))
    return spark.read.parquet(str(root / "library")), spark.read.parquet(str(root / "pages"))


def test_filters_reach_the_scan(stored):
    df, _ = stored
    assert "EqualTo(is_favorite,true)" in plan(lib.favorites(df))
    assert "IsNotNull(last_opened_at)" in plan(lib.recents(df))
    assert "EqualTo(collection_id,3)" in plan(lib.visible_documents(df, selected=3, owner_id="o1")).replace("EqualNullSafe", "EqualTo")
    assert "EqualTo(doc_id,7)" in plan(lib.get_document(df, 7))


def test_top_k_does_not_sort_everything(stored):
    df, _ = stored
    assert "TakeOrderedAndProject" in plan(lib.recents(df))
    assert "WindowGroupLimit" in plan(lib.recents_per_owner(df))


def test_search_shuffles_nothing_and_reads_only_text(stored):
    _, pg = stored
    text = plan(search.search_text(pg, "text"))
    assert "Exchange" not in text and "Python" not in text
    assert "char_rects" not in text
    for narrow in (search.hit_snippets(pg, "text"), search.hit_boxes(pg, "text"), page_ops.explode_chars(pg),
                   search.page_hit_counts(pg, "text"), page_ops.check_alignment(pg)):
        assert "Exchange" not in plan(narrow)


def test_numbering_searches_once(stored):
    _, pg = stored
    for df in (search.hit_navigation(pg, "text"), search.search_report(pg, "text")):
        df.collect()
        assert "ReusedExchange" in plan(df)


def test_counts_combine_before_the_shuffle(stored):
    _, pg = stored
    for df in (search.hit_counts(pg, "text"), page_ops.text_stats(pg), search.first_page_with(pg, "x")):
        text = plan(df)
        assert "partial_" in text and text.count("Exchange") == 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not here")
@pytest.mark.parametrize("name", sorted(set(queries()) - set(LLM_QUERIES) - {"pair_operations", "command_stream", "intake_stream", "last_opened_stream"}))
def test_no_query_compares_all_pairs(spark, name):
    df = queries()[name](spark, SF_DIR)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_percentiles_of_one_busy_operation(spark):
    """Every timing is distinct; no expression or window sees the whole operation."""
    rng = random.Random(4)
    times = [rng.randrange(1 << 40) for _ in range(5_001)]
    rows = [("x", t) for t in times] + [("x", None)] * 3 + [("y", 7), ("z", None), (None, 1), (None, 4)]
    log = spark.createDataFrame(rows, "op string, ms long").selectExpr(
        "op", "ms", "'end' AS phase", "'success' AS result", "1L AS bytes")
    report = operation_report(log)
    got = {r.op: (r.runs, r.min_ms, r.p50_ms, r.p95_ms, r.max_ms) for r in report.collect()}
    low, mid, high = np.percentile(times, [0, 50, 95])
    assert got["x"][:2] == (5_004, int(low)) and got["x"][2] == mid and abs(got["x"][3] - high) < 1e-3
    assert got["y"] == (1, 7, 7.0, 7.0, 7) and got["z"] == (1, None, None, None, None) and got[None] == (2, 1, 2.5, 3.85, 4)
    plan = report._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and all("__part" in w for w in re.findall(r"windowspecdefinition\(([^)]*)\)", plan))


def test_running_count_is_spread(spark):
    rows = spark.range(20_000).selectExpr("'x' AS op", "id AS ms")
    placed = with_running_count(rows, ["op"], ["ms"], F.lit(2), "upto")
    assert placed.where("upto <> 2 * (ms + 1) OR upto_total <> 40000").count() == 0
    assert rows.repartitionByRange(4, "op", "ms").select(F.spark_partition_id()).distinct().count() == 4
