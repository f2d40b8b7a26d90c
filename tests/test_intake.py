import hashlib

import pytest
from helpers import doc, files, library, values
from pyspark.sql import functions as F

from shelfmark.operators import intake
from shelfmark.operators.intake import classify_intake
from shelfmark.operators.library import managed_rows, selected_documents
from shelfmark.sources import snapshots
from shelfmark.sources.extract import ExtractionFailure, extract_pages
from shelfmark.sources.files import export_subset, hash_files, scan_files
from shelfmark.sources.snapshots import (
    NothingProduced,
    ValidationRejected,
    current_tag,
    current_version,
    publish_audited,
    publish_parts,
    read_published,
)

PDF = b"%PDF"


def test_accepted_rejected_and_missing(spark):
    df = files(spark, a=PDF + b"\x01\x02\x03", bad=b"\x01\x02\x03\x04", short=b"%PD", exact=PDF)
    asked = spark.createDataFrame([("a.pdf",), ("bad.pdf",), ("nope.pdf",), ("nope.pdf",)], "path string")
    got = {r.path: (r.failure_code, r.failure_detail) for r in intake.classify_intake(df, asked).collect()}
    assert got == {
        "a.pdf": (None, None), "exact.pdf": (None, None),
        "bad.pdf": ("document_corrupt", "missing %PDF header"),
        "short.pdf": ("document_corrupt", "missing %PDF header"),
        "nope.pdf": ("document_moved", "source file does not exist"),
    }
    assert intake.classify_intake(df).count() == 4


def test_content_address(spark):
    df = intake.content_address(files(spark, b=PDF + b"\x09", c1=PDF + b"\x07", c2=PDF + b"\x07"))
    got = {r.path: r for r in df.collect()}
    digest = hashlib.sha256(PDF + b"\x07").hexdigest()
    assert got["b.pdf"].size_bytes == 5
    assert got["c1.pdf"].content_hash == got["c2.pdf"].content_hash == digest
    assert got["c1.pdf"].relative_path == f"{digest[:2]}/{digest}.pdf"
    assert "content" not in df.columns


def test_managed_rows(spark):
    df = managed_rows(intake.content_address(files(spark, a=PDF)), F.lit("me"))
    row = df.first()
    assert (row.owner_id, row.display_name, row.size_bytes, row.ref.kind) == ("me", "a.pdf", 4, "managed")
    assert row.storage_key == row.content_hash == row.ref.content_hash


def test_triage(spark):
    page = b"/Type /Page /x\n"
    whole = PDF + page * 3 + b"/Type /Pages\n" + b"x" * 200 + b"%%EOF"
    df = files(spark, whole=whole, cut=whole[:-200], script=PDF + b"/JavaScript", locked=PDF + b"/Encrypt",
               many=PDF + b"/Type/Page\xff" * 1000)
    got = {r.path: tuple(r)[1:] for r in intake.triage_bytes(df).collect()}
    assert got["whole.pdf"] == (3, True, False, False)
    assert got["cut.pdf"] == (3, False, False, False)
    assert got["script.pdf"] == (0, False, False, True)
    assert got["locked.pdf"] == (0, False, True, False)
    assert got["many.pdf"][0] == 1000


def test_duplicates_and_footprint(spark):
    df = library(spark, doc(1, "a", digest="h1", size=10), doc(5, "b", digest="h1", size=10),
                 doc(3, "c", digest="h1", size=10), doc(4, "d", digest="h2", size=7),
                 doc(6, "e", digest="h2", kind="external", size=7))
    assert sorted(values(intake.duplicate_groups(df), "content_hash", "copies", "keeper")) == [("h1", 3, 1), ("h2", 2, 4)]
    members = intake.duplicate_members(df).orderBy("content_hash", "doc_id")
    assert values(members, "content_hash", "doc_id", "is_keeper") == [
        ("h1", 1, True), ("h1", 3, False), ("h1", 5, False), ("h2", 4, True), ("h2", 6, False)]
    assert sorted(values(intake.distinct_content(df), "doc_id")) == [1, 4]
    assert intake.distinct_content(df).schema == df.schema
    assert values(intake.storage_footprint(df), "logical_bytes", "stored_bytes", "saved_bytes") == [(37, 17, 20)]


def test_rows_without_a_hash_are_no_duplicates(spark):
    df = library(spark, doc(1, "a", digest="h1"), doc(2, "x", kind="external"), doc(3, "y", kind="external"))
    df = df.withColumn("content_hash", F.when(F.col("ref.kind") == "managed", F.col("content_hash")))
    assert intake.duplicate_groups(df).count() == 0
    assert intake.duplicate_members(df).count() == 0
    assert sorted(values(intake.distinct_content(df), "doc_id")) == [1, 2, 3]


def test_a_shared_file_is_collectable_only_when_no_row_is_left(spark):
    df = library(spark, doc(1, "a", digest="h1"), doc(2, "b", digest="h1"), doc(3, "c", digest="h2"),
                 doc(4, "x", digest="h3", kind="external"))
    stored = spark.createDataFrame([("h1",), ("h2",), ("h4",)], "storage_key string")

    def collectable(*deleted):
        gone = spark.createDataFrame([(i,) for i in deleted] or [(-1,)], "doc_id long")
        return sorted(values(intake.collectable_files(stored, selected_documents(df, gone, keep=False)), "storage_key"))

    assert collectable() == ["h4"]
    assert collectable(1, 3) == ["h2", "h4"]
    assert collectable(1, 2, 4) == ["h1", "h4"]


def test_scan_lists_large_files_without_their_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pdf").write_bytes(PDF + b"1")
    (tmp_path / "in" / "B.PDF").write_bytes(PDF + b"22")
    (tmp_path / "c.txt").write_bytes(b"no")
    df = scan_files(spark, str(tmp_path))
    assert sorted(values(df, "length")) == [5, 6]
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 5)
    try:
        found = classify_intake(scan_files(spark, str(tmp_path))).orderBy("length")
        assert values(found, "length", "content", "failure_code") == [
            (5, bytearray(PDF + b"1"), None), (6, None, "unsupported_feature")]
        assert values(intake.content_address(found), "size_bytes") == [5, 6]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_null_bytes_are_not_accepted(spark):
    df = spark.createDataFrame([("a.pdf", None, None), ("b.pdf", 5, None)], "path string, length long, content binary")
    assert values(classify_intake(df), "failure_code") == ["document_corrupt"] * 2


def test_owners_do_not_share_duplicates(spark):
    df = library(spark, doc(1, "a", owner="x", digest="h"), doc(2, "b", owner="y", digest="h"), doc(3, "c", owner="y", digest="h"))
    assert values(intake.duplicate_groups(df), "owner_id", "copies", "keeper") == [("y", 2, 2)]
    assert values(intake.duplicate_groups(df, intake.GLOBAL), "copies", "keeper") == [(3, 1)]
    assert sorted(values(intake.distinct_content(df), "doc_id")) == [1, 2]
    assert sorted(values(intake.duplicate_members(df), "doc_id")) == [2, 3]


def test_export(spark, tmp_path):
    df = library(spark, doc(1, "a", digest="h1", size=3), doc(2, "b", digest="h1", size=3), doc(3, "c", digest="h2", size=4))
    contents = spark.createDataFrame([("h1", bytearray(b"abc")), ("h2", bytearray(b"oops!"))], "storage_key string, content binary")
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    target = str(tmp_path / "out")
    export_subset(df, ids, contents, target)
    assert sorted(values(read_published(spark, target), "doc_id", "content")) == [(1, bytearray(b"abc")), (2, bytearray(b"abc"))]
    with pytest.raises(ValidationRejected):  # recorded size differs from the bytes
        export_subset(df, spark.createDataFrame([(3,)], "doc_id long"), contents, str(tmp_path / "bad"))
    missing = contents.where("storage_key = 'none'")
    with pytest.raises(ValidationRejected):
        export_subset(df, ids, missing, str(tmp_path / "none"))


def leftovers(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("data-")) if path.exists() else []


def test_publish_and_replace(spark, tmp_path):
    target = str(tmp_path / "t")
    assert current_version(spark, target) is None
    assert publish_audited(spark, lambda: spark.range(3), target, tag="first") == 0
    assert publish_audited(spark, lambda: spark.range(5), target, lambda w: w.count() == 5) == 1
    assert read_published(spark, target).count() == 5
    assert read_published(spark, target, 0).count() == 3
    assert current_tag(spark, target) is None


def test_failed_publish_keeps_the_old_version_and_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "t"
    target = str(folder)
    publish_audited(spark, lambda: spark.range(3), target)
    kept = leftovers(folder)

    def broken():
        raise OSError("disk died")

    failing = spark.range(3).selectExpr("raise_error('late') AS x")
    for produce, validate, error in (
        (broken, None, OSError), (lambda: None, None, NothingProduced),
        (lambda: spark.range(0), None, NothingProduced),
        (lambda: spark.range(9), lambda w: False, ValidationRejected),
        (lambda: failing, None, Exception),
    ):
        with pytest.raises(error):
            publish_audited(spark, produce, target, validate)
        assert read_published(spark, target).count() == 3
        assert leftovers(folder) == kept


def test_nothing_becomes_visible_when_the_first_publish_fails(spark, tmp_path):
    target = str(tmp_path / "never")
    with pytest.raises(ValidationRejected):
        publish_audited(spark, lambda: spark.range(1), target, lambda w: False)
    with pytest.raises(FileNotFoundError):
        read_published(spark, target)
    assert leftovers(tmp_path / "never") == []


def test_an_unfinished_marker_is_not_read_and_blocks_nobody(spark, tmp_path):
    target = str(tmp_path / "t")
    publish_audited(spark, lambda: spark.range(1), target)
    lost = tmp_path / "t" / "_versions" / "version=1" / "_temporary" / "0"
    lost.mkdir(parents=True)
    (lost / "part-0.parquet").write_bytes(b"half")
    assert current_version(spark, target) == 0
    assert read_published(spark, target).count() == 1
    assert publish_audited(spark, lambda: spark.range(2), target) == 1
    assert read_published(spark, target).count() == 2


def test_data_stays_when_its_marker_may_have_been_stored(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    publish_audited(spark, lambda: spark.range(1), target)
    mark = snapshots._mark

    def breaks_late(*args):
        mark(*args)
        raise OSError("connection lost")

    monkeypatch.setattr(snapshots, "_mark", breaks_late)
    with pytest.raises(OSError):
        publish_audited(spark, lambda: spark.range(2), target)
    assert read_published(spark, target).count() == 2


def test_only_touched_parts_are_written(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.range(1000).withColumn("v", F.lit("old"))
    publish_audited(spark, lambda: rows, target, key="id", parts=16)
    touched = [r[0] for r in spark.range(3).select(snapshots.part_of("id", 16)).distinct().collect()]
    changed = read_published(spark, target, parts=touched).withColumn("v", F.when(F.col("id") < 3, "new").otherwise(F.col("v")))
    assert 0 < changed.count() < 400
    assert publish_parts(spark, changed, touched, target, "id", tag="t") == 1
    got = read_published(spark, target)
    assert (got.count(), got.where("v = 'new'").count(), current_tag(spark, target)) == (1000, 3, "t")
    assert read_published(spark, target, 0).where("v = 'new'").isEmpty()
    written = sorted((tmp_path / "t").glob("data-*"), key=lambda p: p.stat().st_mtime)[-1]
    assert {p.name for p in written.glob("__part=*")} == {f"__part={p}" for p in touched}
    # All rows of a part may go, and a version may move its tag alone.
    publish_parts(spark, changed.where("false"), touched, target, "id")
    assert read_published(spark, target).count() == 1000 - changed.count()
    publish_parts(spark, None, [], target, "id", tag=7)
    assert current_tag(spark, target) == 7 and len(list((tmp_path / "t").glob("data-*"))) == 3
    publish_parts(spark, rows.where("false"), range(16), target, "id")
    assert read_published(spark, target).count() == 0 and read_published(spark, target).columns == ["id", "v"]


def test_extract_pages(spark):
    df = files(spark, good=b"one|two", empty=b"", locked=b"!", odd=b"?", none=b"0")

    def extractor(path, content):
        text = content.decode()
        if text == "!":
            raise ExtractionFailure("password_required", "needs a password")
        if text == "?":
            raise ValueError("surprise")
        if text == "0":
            return [(0, None, None)]
        return [(i, t, [(0, 1, 2, 3)] * len(t)) for i, t in enumerate(text.split("|")) if t]

    got = {}
    for r in extract_pages(df, extractor).collect():
        got.setdefault(r.path, []).append((r.page_index, r.full_text, None if r.char_rects is None else len(r.char_rects),
                                           r.failure_code))
    assert sorted(got["good.pdf"]) == [(0, "one", 3, None), (1, "two", 3, None)]
    assert got["empty.pdf"] == [(None, None, None, "document_corrupt")]
    assert got["locked.pdf"] == [(None, None, None, "password_required")]
    assert got["odd.pdf"] == [(None, None, None, "unknown")]
    assert got["none.pdf"] == [(0, None, None, None)]


def test_extractor_failing_midway_keeps_no_page(spark):
    def extractor(path, content):
        yield 0, "fine", None
        raise ExtractionFailure("no_such_code")

    rows = extract_pages(files(spark, a=b"x"), extractor, partitions=2).collect()
    assert [(r.page_index, r.failure_code) for r in rows] == [(None, "unknown")]


def test_files_beyond_the_limit_are_hashed_in_pieces(spark, tmp_path):
    bodies = {"a.pdf": PDF + b"1", "two words.pdf": PDF + bytes(range(256)) * 9, "ü%20.pdf": b"no magic" * 50}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 5)
    try:
        rows = hash_files(scan_files(spark, str(tmp_path)), piece_bytes=7).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    got = {r.path.rsplit("/", 1)[1]: r for r in rows}
    assert len(rows) == len(bodies) and all(r.failure_detail is None for r in rows)
    for name, body in bodies.items():
        r = got[name]
        digest = hashlib.sha256(body).hexdigest()
        assert (r.content_hash, r.size_bytes, r.relative_path) == (digest, len(body), f"{digest[:2]}/{digest}.pdf")
        assert bool(r.is_pdf) == body.startswith(PDF)


def test_large_files_that_cannot_be_read_say_so(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(PDF)
    (tmp_path / "empty.pdf").write_bytes(b"")
    listed = spark.createDataFrame([(f"file:{tmp_path}/gone.pdf", 9, None), (f"file:{tmp_path}/b.pdf", 99, None),
                                    (f"file:{tmp_path}/empty.pdf", 0, None)], "path string, length long, content binary")
    empty, *got = hash_files(listed).orderBy("size_bytes").collect()
    assert (empty.content_hash, empty.failure_detail) == (hashlib.sha256(b"").hexdigest(), None)
    assert [r.content_hash for r in got] == [None, None]
    assert "gone.pdf" in got[0].failure_detail and got[1].failure_detail == "file has 4 bytes and was listed with 99"


def test_point_lookups_open_only_row_groups_that_may_hold_the_id(spark, tmp_path):
    ids = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    publish_audited(spark, lambda: ids, str(tmp_path / "t"), key="doc_id", parts=4, lookup="doc_id")
    table = read_published(spark, str(tmp_path / "t"))

    def rows_scanned(doc_id):
        found = table.where(F.col("doc_id") == doc_id)
        plan = found._jdf.queryExecution().executedPlan()
        n = len(plan.executeCollect())
        return n, plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert rows_scanned(7_001) == (0, 0)  # inside the files' ranges, but in none
    found, scanned = rows_scanned(7_000)
    assert found == 1 and 0 < scanned < 10_000  # the four parts have the same range; the filter tells them apart
    filters, written = 0, list((tmp_path / "t").glob("data-*/__part=*/*.parquet"))
    jvm = spark._jvm
    for file in written:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
            jvm.org.apache.hadoop.fs.Path(str(file)), spark._jsc.hadoopConfiguration())
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        filters += sum(b.getColumns().get(0).getBloomFilterOffset() > 0 for b in reader.getFooter().getBlocks())
        reader.close()
    assert filters == len(written) >= 4
