import random

from helpers import values

from shelfmark import schemas
from shelfmark.operators.outline import flatten_outline, preorder_rank


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.OUTLINE_NODES)


def entries(df):
    return [tuple(r) for r in df.orderBy("doc_id", "path").select("title", "page_index", "depth").collect()]


def test_depth_first_with_depth(spark):
    df = nodes(
        spark, (1, "b", None, 1, "Chapter 2", 10), (1, "a2", "a", 1, "Section 1.2", 4), (1, "a", None, 0, "Chapter 1", 0),
        (1, "a1", "a", 0, "Section 1.1", 2))
    assert entries(flatten_outline(df)) == [
        ("Chapter 1", 0, 0), ("Section 1.1", 2, 1), ("Section 1.2", 4, 1), ("Chapter 2", 10, 0)]
    assert sorted(values(preorder_rank(df), "position", "title")) == [
        (0, "Chapter 1"), (1, "Section 1.1"), (2, "Section 1.2"), (3, "Chapter 2")]


def test_null_target_is_kept_and_empty_stays_empty(spark):
    assert entries(flatten_outline(nodes(spark, (1, "x", None, 0, "Unlinked", None)))) == [("Unlinked", None, 0)]
    assert flatten_outline(nodes(spark)).count() == 0


def test_deep_chain_wide_parent_and_several_documents(spark):
    rows = [(1, f"c{i}", f"c{i - 1}" if i else None, 0, f"c{i}", i) for i in range(150)]
    rows += [(2, "root", None, 0, "root", 0)] + [(2, f"k{i}", "root", i, f"k{i}", i) for i in range(300)]
    random.seed(2)
    random.shuffle(rows)
    got = {(r.doc_id, r.node_id): (r.depth, r.position) for r in preorder_rank(nodes(spark, *rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[(1, f"c{i}")] == (i, i) for i in range(150))
    assert all(got[(2, f"k{i}")] == (1, i + 1) for i in range(300))


def test_unreachable_nodes_are_left_out(spark):
    df = nodes(spark, (1, "a", None, 0, "a", 0), (1, "x", "y", 0, "x", 0), (1, "y", "x", 0, "y", 0), (1, "o", "gone", 0, "o", 0),
               (1, "z", "x", 1, "z", 0))
    assert entries(flatten_outline(df)) == [("a", 0, 0)]


def test_siblings_with_equal_order_keep_their_children(spark):
    df = nodes(spark, (1, "a", None, 0, "A", 0), (1, "b", None, 0, "B", 0), (1, "a1", "a", 0, "A1", 0), (1, "a2", "a", 1, "A2", 0),
               (1, "b1", "b", 0, "B1", 0), (1, "b2", "b", 1, "B2", 0))
    assert [e[0] for e in entries(flatten_outline(df))] == ["A", "A1", "A2", "B", "B1", "B2"]
