import hashlib
from datetime import datetime

import pytest
from helpers import collections, doc, files, library, values
from pyspark.sql import functions as F

from shelfmark.functions.documents import tile_line
from shelfmark.operators import audit
from shelfmark.operators import library as lib


def names(df):
    return values(df, "display_name")


def test_sort_by_name_ignores_case(spark):
    df = library(spark, doc(1, "banana.pdf"), doc(2, "Apple.pdf"), doc(3, "cherry.pdf"))
    assert names(lib.sort_documents(df, "name", True)) == ["Apple.pdf", "banana.pdf", "cherry.pdf"]
    assert names(lib.sort_documents(df, "name", False)) == ["cherry.pdf", "banana.pdf", "Apple.pdf"]
    assert names(df) == ["banana.pdf", "Apple.pdf", "cherry.pdf"]


def test_sort_by_size_and_added(spark):
    df = library(spark, doc(1, "big.pdf", size=900, added=datetime(2026, 2, 1)), doc(2, "small.pdf", size=10))
    assert names(lib.sort_documents(df, "size", True))[0] == "small.pdf"
    assert names(lib.sort_documents(df))[0] == "big.pdf"


def test_never_opened_counts_as_oldest(spark):
    df = library(spark, doc(1, "never.pdf"), doc(2, "opened.pdf", opened=datetime(2026, 5, 1)))
    assert names(lib.sort_documents(df, "date_opened", False)) == ["opened.pdf", "never.pdf"]
    assert names(lib.sort_documents(df, "date_opened", True)) == ["never.pdf", "opened.pdf"]


def test_ties_go_to_the_smaller_id(spark):
    df = library(spark, doc(9, "b"), doc(3, "a"), doc(5, "c"))
    for ascending in (True, False):
        assert values(lib.sort_documents(df, "size", ascending), "doc_id") == [3, 5, 9]


def test_unknown_sort_field(spark):
    with pytest.raises(ValueError):
        lib.sort_order("colour", True)


@pytest.mark.parametrize("query,expected", [
    ("invoice", 1), ("  INVOICE ", 1), ("", 4), ("   ", 4), ("zzz", 0), ("%", 1), ("_", 1), (".", 4)])
def test_filter_by_name_is_literal(spark, query, expected):
    df = library(spark, doc(1, "Invoice March.pdf"), doc(2, "notes.pdf"), doc(3, "100%.pdf"), doc(4, "a_b.pdf"))
    assert lib.filter_by_name(df, query).count() == expected


def test_recents_limit_order_and_exclusion(spark):
    rows = [doc(i, f"doc{i}", opened=datetime(2026, 5, i)) for i in range(1, 6)] + [doc(6, "never")]
    df = library(spark, *rows)
    assert names(lib.recents(df, 3)) == ["doc5", "doc4", "doc3"]
    assert lib.opened_only(df).count() == 5
    assert "never" not in names(lib.recents(df))


def test_recents_per_owner_equals_recents_of_each(spark):
    rows = [doc(i, f"d{i}", owner=f"o{i % 3}", opened=datetime(2026, 1, 1 + i % 5)) for i in range(30)]
    df = library(spark, *rows)
    per = lib.recents_per_owner(df, 4)
    for owner in ("o0", "o1", "o2"):
        alone = values(lib.recents(df.where(F.col("owner_id") == owner), 4), "doc_id")
        assert values(per.where(F.col("owner_id") == owner).orderBy("recent_rank"), "doc_id") == alone
    assert sorted(values(lib.recents_per_owner(df, 2000), "doc_id")) == list(range(30))


def test_favorites_and_collections(spark):
    df = library(spark, doc(1, "a", favorite=True), doc(2, "b", collection=7), doc(3, "c", collection=8))
    assert names(lib.favorites(df)) == ["a"]
    df = df.union(library(spark, doc(9, "other", owner="p", collection=7)))
    assert names(lib.documents_in(df, 7, "o")) == ["b"]
    assert names(lib.documents_in(df, None, "o")) == ["a"]
    assert lib.in_selected_collection(df).count() == 4
    assert names(lib.in_selected_collection(df, owner_id="p")) == ["other"]
    assert names(lib.visible_documents(df, "B", selected=7, owner_id="o")) == ["b"]
    assert names(lib.visible_documents(df, selected=7, owner_id="p")) == ["other"]
    with pytest.raises(ValueError, match="owner"):
        lib.in_selected_collection(df, 7)


def test_name_filter_folds_letters_as_search_does(spark):
    df = library(spark, doc(1, "\u039f\u0394\u039f\u03a3.pdf"), doc(2, "x"))
    assert names(lib.filter_by_name(df, "\u03bf\u03b4\u03bf\u03c3")) == names(lib.filter_by_name(df, "\u039f\u0394\u039f\u03a3")) == ["\u039f\u0394\u039f\u03a3.pdf"]


def test_patches_multiply_no_rows(spark):
    df = library(spark, doc(1, "a"), doc(2, "b"))
    patches = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, None)], "seq long, doc_id long, display_name string")
    assert sorted(values(lib.patch_fields(df, patches, ["display_name"]), "doc_id", "display_name")) == [(1, "y"), (2, "b")]


def test_get_document(spark):
    df = library(spark, doc(1, "a"), doc(2, "b"))
    assert names(lib.get_document(df, 2)) == ["b"]
    with pytest.raises(Exception, match="no document with id 5"):
        lib.get_document(df, 5).collect()
    with pytest.raises(Exception, match="no document with id 5"):
        lib.get_document(df, 5).select("display_name").collect()


def test_attach_collection_keeps_root_documents(spark):
    df = library(spark, doc(1, "a"), doc(2, "b", collection=1), doc(3, "c", collection=9))
    out = lib.attach_collection(df, collections(spark, (1, "Invoices")))
    assert dict(values(out, "display_name", "collection_name")) == {"a": None, "b": "Invoices", "c": None}


def test_collection_counts(spark):
    df = library(spark, doc(1, "a", size=5), doc(2, "b", size=6), doc(3, "c", collection=1, size=7))
    out = audit.collection_counts(df, collections(spark, (1, "In"), (2, "Empty")))
    assert sorted(values(out, "collection_id", "name", "documents", "bytes"), key=str) == sorted(
        [(None, None, 2, 11), (1, "In", 1, 7), (2, "Empty", 0, 0)], key=str)


def test_selected_documents(spark):
    df = library(spark, doc(1, "a"), doc(2, "b"))
    ids = spark.createDataFrame([(2,), (2,), (4,)], "doc_id long")
    assert names(lib.selected_documents(df, ids)) == ["b"]
    assert names(lib.selected_documents(df, ids, keep=False)) == ["a"]


def test_patch_never_clears(spark):
    df = library(spark, doc(1, "a", pages=3), doc(2, "b"))
    patch = spark.createDataFrame([(1, None, "new")], "doc_id long, page_count int, display_name string")
    out = lib.patch_fields(df, patch, ["page_count", "display_name"])
    assert sorted(values(out, "doc_id", "display_name", "page_count")) == [(1, "new", 3), (2, "b", None)]


def test_insert_gives_increasing_ids_and_defaults(spark):
    df = library(spark, doc(10, "a"))
    batch = df.select("owner_id", "ref", "storage_key", "content_hash", "size_bytes").crossJoin(
        spark.createDataFrame([("z",), ("x",), ("y",)], "display_name string"))
    out = lib.insert_documents(df, batch, "2026-06-01 00:00:00")
    new = out.where("doc_id > 10").orderBy("doc_id")
    assert values(new, "doc_id", "display_name") == [(11, "x"), (12, "y"), (13, "z")]
    row = new.first()
    assert (row.is_favorite, row.last_opened_at, row.page_count, row.collection_id) == (False, None, None, None)
    assert row.added_at == datetime(2026, 6, 1)
    assert out.schema == df.schema


def test_insert_into_an_empty_library(spark):
    empty = library(spark)
    batch = spark.createDataFrame([("o", "a")], "owner_id string, display_name string")
    assert values(lib.insert_documents(empty, batch, "2026-06-01"), "doc_id") == [1]


def test_register_external(spark):
    found = spark.createDataFrame([("/x/y/z.pdf", 12)], "path string, length long")
    out = lib.register_external(library(spark, doc(1, "a")), found, F.lit("o"), "2026-06-01").where("doc_id = 2").first()
    assert (out.ref.kind, out.ref.handle.path, out.display_name, out.size_bytes, out.content_hash) == (
        "external", "/x/y/z.pdf", "z.pdf", 12, None)


def test_upgrade_schema(spark):
    v2 = library(spark, doc(1, "a", collection=4))
    up, cols = lib.upgrade_schema(v2.drop("collection_id"))
    assert values(up, "collection_id") == [None] and up.schema["collection_id"].dataType.simpleString() == "bigint"
    assert cols.count() == 0
    same, _ = lib.upgrade_schema(v2)
    assert values(same, "collection_id") == [4]


def test_duplicate_is_a_distinct_copy(spark):
    df = library(spark, doc(1, "e.pdf", favorite=True, pages=3, collection=2, opened=datetime(2026, 3, 3), size=5))
    asked = spark.createDataFrame([(7, 1), (8, 1), (9, 99)], "seq long, doc_id long")
    out = lib.duplicate_documents(df, asked, "2026-06-01")
    copies = out.where("doc_id > 1").orderBy("doc_id").collect()
    assert [c.display_name for c in copies] == ["e.pdf copy", "e.pdf copy"]
    assert len({c.storage_key for c in copies} | {df.first().storage_key}) == 3
    for c in copies:
        assert (c.size_bytes, c.content_hash, c.is_favorite, c.last_opened_at, c.page_count, c.collection_id) == (
            5, "hash-e.pdf", False, None, None, None)
        assert c.ref.relative_path.startswith(c.storage_key[:2] + "/")


@pytest.mark.parametrize("size,pages,managed,line", [
    (0, None, False, "0 KB"), (512, None, False, "1 KB"), (1536, 3, True, "2 KB · 3 pages · Imported copy"),
    (2560, None, True, "3 KB · Imported copy"), (511, 1, False, "0 KB · 1 pages")])
def test_tile_line(spark, size, pages, managed, line):
    df = spark.createDataFrame([(size, pages, managed)], "s long, p int, m boolean")
    assert df.select(tile_line(F.col("s"), F.col("p"), F.col("m"))).first()[0] == line


def test_import_skips_known_content(spark):
    known = hashlib.sha256(b"%PDF1").hexdigest()
    df = library(spark, doc(1, "old", digest=known), doc(2, "other", owner="p"))
    batch = files(spark, a=b"%PDF1", b=b"%PDF2", c=b"%PDF2", d=b"nope")
    out = lib.import_files(df, batch, "o", "2026-06-01")
    assert sorted(values(out, "doc_id", "owner_id", "display_name")) == [(1, "o", "old"), (2, "p", "other"), (3, "o", "b.pdf")]
    assert sorted(values(lib.import_files(df, batch, "p", "2026-06-01").where("doc_id > 2"), "display_name")) == ["a.pdf", "b.pdf"]


def test_copies_of_unread_files_fail(spark):
    df = library(spark, doc(1, "m.pdf"), doc(2, "x.pdf", kind="external")).withColumn(
        "content_hash", F.when(F.col("ref.kind") == "managed", F.col("content_hash")))
    asked = spark.createDataFrame([(10, 1), (11, 2), (12, 77)], "seq long, doc_id long")
    got = {r.seq: r for r in lib.plan_copies(df, asked).collect()}
    assert got[10].failure_code is None and got[10].source_key == "hash-m.pdf"
    assert [got[i].failure_detail for i in (11, 12)] == ["source content is not resolved", "no such document"]
    assert lib.duplicate_documents(df, asked, "2026-06-01").count() == 3
    read = spark.createDataFrame([(2, "h2", 9)], "doc_id long, content_hash string, size_bytes long")
    copy = lib.duplicate_documents(df, asked, "2026-06-01", read).where("display_name = 'x.pdf copy'").first()
    assert (copy.content_hash, copy.size_bytes, copy.ref.content_hash) == ("h2", 9, "h2")
