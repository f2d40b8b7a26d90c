"""Work that must not grow faster than the tables."""

import pytest
from helpers import pages, values
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.catalog.page_queries import QUERIES
from shelfmark.functions.text import character_of, code_point, line_boxes
from shelfmark.operators import page_index, terms
from shelfmark.operators import pages as page_ops
from shelfmark.sources import snapshots


@pytest.fixture
def tables(spark, tmp_path):
    """Documents whose lines, the pages, hold characters of one to four bytes."""
    texts = ["ab c\n😀é\n\nz", "x", "", "\U0010ffffa\n\u0000"]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    return str(tmp_path), texts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joined_columns(df):
    """Names of the columns that the sides of a query's joins hand on."""
    def joins(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        return [c for child in children for c in joins(child)] + (children if node.nodeName() == "Join" else [])

    sides = [side.output() for side in joins(df._jdf.queryExecution().optimizedPlan())]
    return {out.apply(i).name() for out in sides for i in range(out.size())}


def test_characters_are_combined_without_a_sort(spark, tables):
    path, texts = tables
    df = QUERIES["explode_chars"](spark, path)
    assert "Sort" not in plan_of(df)
    want = {(d, p): (len(t), min(t), max(t)) for d, text in enumerate(texts) for p, t in enumerate(text.split("\n")) if t}
    assert {(r.doc_id, r.page_index): (r.chars, r.low, r.high) for r in df.collect()} == want


def test_code_points_and_back(spark):
    chars = ["\u0000", "a", "é", "퟿", "", "￿", "😀", "\U0010ffff"]
    df = spark.createDataFrame([(c,) for c in chars], "c string").select("c", code_point(F.col("c")).alias("n"))
    got = df.select("c", "n", character_of(F.col("n")).alias("back")).collect()
    assert {(r.c, r.n, r.back) for r in got} == {(c, ord(c), c) for c in chars}


def test_alignment_shuffles_counts_alone(spark, tables):
    path, texts = tables
    df = QUERIES["check_alignment"](spark, path)
    assert joined_columns(df) == {"doc_id", "page_index", "rects", "units"}
    units = [[len(t.encode("utf-16-le")) // 2 for t in text.split("\n")] for text in texts]
    want = [(d, p, before, n) for d, ns in enumerate(units) for p, (before, n) in enumerate(zip([0, *ns], ns, strict=False)) if before != n]
    assert sorted(values(df, "doc_id", "page_index", "rects", "units")) == want


def test_alignment_with_rectangles_of_another_table(spark):
    rect = (0.0, 800.0, 7.0, 788.0)
    text = pages(spark, (1, 0, "ab", None), (2, 0, "😀", None), (3, 0, None, None), (4, 0, "q", None), (5, 0, "w", None)).drop("char_rects")
    laid = pages(spark, (1, 0, None, [rect] * 2), (2, 0, None, [rect]), (3, 0, None, [rect]), (5, 0, None, None), (6, 0, None, [rect]))
    got = values(page_ops.check_alignment(text, laid), "doc_id", "rects", "units")
    assert sorted(got) == [(2, 1, 2), (3, 1, 0), (4, 0, 1), (5, 0, 1)]


def test_index_is_built_without_an_exchange(spark, tmp_path):
    """Postings are written as they come, and a hit that overlaps another needs no look at the text."""
    table = pages(spark, (1, 0, "thathat that", None), (2, 0, "aaaaa xthat", None), (3, 0, "none", None))
    spark.sparkContext.setJobGroup("index", "index")
    page_index.add_pages(table.coalesce(1), str(tmp_path), "0")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup("index")
    assert jobs and all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs)
    index, unread = page_index.read_index(spark, str(tmp_path)), table.where("raise_error('read') IS NULL")
    for query, want in (("that", [(1, 0), (1, 8), (2, 7)]), ("aaa", [(2, 0)]), ("the", [])):
        assert sorted(values(page_index.search_index(index, unread, query), "doc_id", "offset")) == want


def test_lines_are_told_apart_without_a_comparator(spark, tables):
    """Rectangles are compared by Spark's own order, and those of one line not at all; odd values give what sorting gives."""
    path, texts = tables
    df = QUERIES["rect_bounds"](spark, path)
    assert "array_sort" not in plan_of(df)
    want = [(d, p, 0.0, 800.0, 7.0 * (len(t.encode("utf-16-le")) // 2), 788.0)
            for d, text in enumerate(texts) for p, t in enumerate(text.split("\n")) if t]
    assert sorted(map(tuple, df.collect())) == want
    nan, none = float("nan"), None
    odd = {1: [(1.0, none, 2.0, 3.0), (0.0, none, 4.0, none)], 2: [(none, 5.0, none, nan), (nan, 5.0, 1.0, 2.0)],
           3: [(1.0, 5.0, 2.0, 0.0), (0.0, 9.0, 1.0, 8.0), (4.0, 5.0, 6.0, -1.0)], 4: [], 5: None}
    got = {r.doc_id: r.b and [tuple(x) for x in r.b] for r in spark.createDataFrame(
        [(d, 0, "x", v) for d, v in odd.items()], schemas.PAGE_TEXT).select("doc_id", line_boxes(F.col("char_rects")).alias("b")).collect()}
    assert got[1] == [(0.0, None, 4.0, 3.0)] and got[3] == [(1.0, 5.0, 6.0, -1.0), (0.0, 9.0, 1.0, 8.0)]
    assert str(got[2]) == str([(nan, 5.0, 1.0, 2.0)]) and got[4] == [] and got[5] is None


def test_a_part_is_one_file_however_many_tasks_hold_it(spark, tmp_path):
    """Files of a version follow its parts and size, not tasks times parts."""
    rows = spark.range(0, 4_000, 1, 16).selectExpr("id AS doc_id", "concat('n', id) AS name")
    snapshots.publish_audited(spark, lambda: rows, str(tmp_path), key="doc_id", parts=8)
    snapshots.publish_parts(spark, rows.where("doc_id % 3 = 0"), range(8), str(tmp_path), "doc_id")
    files = [len(list(folder.glob("__part=*/*.parquet"))) for folder in tmp_path.glob("data-*")]
    assert files == [8, 8]
    assert sorted(values(snapshots.read_published(spark, str(tmp_path)), "doc_id")) == list(range(0, 4_000, 3))


def test_only_keys_of_terms_become_rows(spark, monkeypatch):
    """A text without a key is one row, and one with keys is a row for each, however many pieces it has."""
    monkeypatch.setattr(terms, "SLICE", 5)
    texts = [None, "", "ab", "xabcxabc", "q" * 40, "z😀éq", "bc", "😀", "abcabd" * 5]
    keys = ["abc", "abd", "é", "😀", "z😀é", "cab", "bc", "q😀é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    pack = spark.createDataFrame([(k,) for k in [*keys, *keys]], "piece string")
    got = sorted(values(terms.cut_texts(rows, "text", pack), "i", "piece"), key=str)
    held = [(i, k) for i, t in enumerate(texts) for k in [k for k in keys if k in (t or "")] or [None]]
    assert got == sorted(held, key=str)
    none = terms.cut_texts(rows, "text", pack.where("false"))
    assert sorted(values(none, "i", "piece")) == [(i, None) for i in range(len(texts))]
