import pytest
from helpers import doc, library, values
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.documents import copy_allowed, decode_permissions, rebase_page
from shelfmark.functions.refs import decode_ref, decode_ref_strict, encode_ref, is_managed
from shelfmark.operators import audit, oplog, pages, references

REFS = [
    ("managed", "a1b2/invoice.pdf", "deadbeef", None, None),
    ("external", None, None, "x.pdf", ("path", None, None, "C:\\Users\\a\\Documents\\x.pdf")),
    ("external", None, None, "y.pdf", ("bookmark", bytearray([0, 1, 2, 250, 255]), None, None)),
    ("external", None, None, "z \"q\".pdf", ("contentUri", None, "content://com.android.providers/document/1234", None)),
]


def frame(spark, refs):
    schema = schemas.T.StructType([schemas.T.StructField("ref", schemas.REF)])
    return spark.createDataFrame([(r,) for r in refs], schema)


def test_round_trip_is_exact(spark):
    df = frame(spark, REFS)
    out = df.select("ref", decode_ref(encode_ref(F.col("ref"))).alias("d"))
    for row in out.collect():
        assert row.d.error is None and row.d.ref == row.ref
    strict = df.select("ref", decode_ref_strict(encode_ref(F.col("ref"))).alias("d"))
    assert all(r.ref == r.d for r in strict.collect())
    assert df.where(is_managed(F.col("ref"))).count() == 1


def test_wire_format(spark):
    got = values(frame(spark, REFS[:1]).select(encode_ref(F.col("ref")).alias("j")), "j")
    assert got == ['{"kind":"managed","relativePath":"a1b2/invoice.pdf","contentHash":"deadbeef"}']


MALFORMED = {
    "not-json": "payload is not an object",
    "[1]": "payload is not an object",
    '"text"': "payload is not an object",
    "{": "payload is not an object",
    '{"kind":"managed","relativePath":"a","contentHash":"b"} x': "payload is not an object",
    '{"kind":"managed","relativePath":"a","contentHash":"b"},{}': "payload is not an object",
    '{"kind":"managed","relativePath":"a","contentHash":"b"}}': "payload is not an object",
    "{'kind':'managed','relativePath':'a','contentHash':'b'}": "payload is not an object",
    "": "payload is not an object",
    '{"kind":"managed","relativePath":"a","contentHash":"b"}],[{}': "payload is not an object",
    '{"kind":"managed","relativePath":"a","contentHash":"b"}],{"x":[': "payload is not an object",
    '{"kind":"magic"}': "unknown kind: magic",
    "{}": "unknown kind: null",
    '{"kind":"managed"}': "field is missing",
    '{"kind":"external","displayName":"a"}': "field is missing",
    '{"kind":"external","displayName":"a","handle":{"type":"ftp"}}': "unknown handle type: ftp",
    '{"kind":"external","displayName":"a","handle":{}}': "unknown handle type: null",
    '{"kind":"external","displayName":"a","handle":{"type":"path"}}': "field is missing",
    '{"kind":"external","displayName":"a","handle":{"type":"bookmark","data":"%%"}}': "bookmark is not base64",
}


def test_malformed_references_are_errors(spark):
    df = spark.createDataFrame([(k,) for k in MALFORMED] + [(None,)], "e string")
    rows = df.select("e", decode_ref(F.col("e")).alias("d")).collect()
    got = {r.e: r.d.error for r in rows}
    assert got == {**MALFORMED, None: "payload is missing"}
    assert all(r.d.ref is None for r in rows)


@pytest.mark.parametrize("text", ["not-json", '{"kind":"magic"}'])
def test_strict_decoding_fails_the_query(spark, text):
    with pytest.raises(Exception, match="malformed document reference"):
        spark.createDataFrame([(text,)], "e string").select(decode_ref_strict(F.col("e"))).collect()


def test_resolve(spark):
    handles = {
        "ok": ("contentUri", None, "u-ok", None), "stale": ("contentUri", None, "u-stale", None),
        "revoked": ("bookmark", bytearray(b"rev"), None, None), "missing": ("contentUri", None, "u-missing", None),
        "odd": ("contentUri", None, "u-odd", None), "unlisted": ("contentUri", None, "u-none", None),
        "path": ("path", None, None, "/here.pdf"), "gone": ("path", None, None, "/gone.pdf"),
    }
    rows = [doc(i, n, kind="external", handle=h) for i, (n, h) in enumerate(handles.items())]
    rows += [doc(20, "kept", digest="aa1"), doc(21, "lost", digest="bb1")]
    present = spark.createDataFrame([("aa/aa1.pdf",), ("/here.pdf",)], "path string")
    grants = spark.createDataFrame(
        [("u-ok", "ok"), ("u-stale", "stale"), ("cmV2", "revoked"), ("u-missing", "missing"), ("u-odd", "boom")],
        "handle string, status string")
    out = references.resolve_refs(library(spark, *rows), present, grants)
    got = {r.display_name: (r.readable_path, r.failure_code) for r in out.collect()}
    assert got == {
        "ok": ("u-ok", None), "stale": (None, "permission_revoked"), "revoked": (None, "permission_revoked"),
        "missing": (None, "document_moved"), "odd": (None, "unknown"), "unlisted": (None, "document_moved"),
        "path": ("/here.pdf", None), "gone": (None, "document_moved"),
        "kept": ("aa/aa1.pdf", None), "lost": (None, "document_moved"),
    }
    messages = audit.attach_failure_message(out)
    assert messages.count() == 10
    row = messages.where("display_name = 'lost'").first()
    assert row.title == "This document has moved."


def test_failure_dimension(spark):
    df = schemas.failure_messages(spark)
    assert df.count() == 8
    assert audit.assert_unique(df, "code").first().is_unique
    codes = df.select(F.col("code").alias("name"))
    assert audit.undocumented(codes, codes).count() == 0
    assert df.where("title = '' OR body = ''").count() == 0


def test_assert_unique_violations(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "k string")
    r = audit.assert_unique(df, "k").first()
    assert (r.total, r.distinct_keys, r.blank_keys, r.is_unique) == (4, 2, 2, False)


def test_deny_list(spark):
    items = spark.createDataFrame([
        ("bad", "Licensed under the GNU General Public License v3"), ("good", "MIT License"), ("none", None),
        ("two", "Gnu Affero and server side public license")], "item string, text string")
    assert sorted(values(audit.deny_list_hits(items), "item", "term")) == [
        ("bad", "GNU GENERAL PUBLIC LICENSE"), ("two", "GNU AFFERO"), ("two", "Server Side Public License")]
    got = {r.item: r.passed for r in audit.deny_list_verdict(items).collect()}
    assert got["bad"] is False and got["good"] is True and got["two"] is False


def test_undocumented_and_unmentioned(spark):
    names = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "name string")
    record = spark.createDataFrame([("alpha",)], "name string")
    assert sorted(values(audit.undocumented(names, record), "name")) == ["beta", "gamma"]
    texts = spark.createDataFrame([("uses betamax",), ("Gamma",)], "text string")
    assert sorted(values(audit.unmentioned(names, texts), "name")) == ["alpha", "gamma"]


@pytest.mark.parametrize("flags,copy,printing,modify,annotate", [
    (-44, True, True, False, False), (-60, False, True, False, False), (4, False, True, False, False),
    (16, True, False, False, False)])
def test_permission_bits(spark, flags, copy, printing, modify, annotate):
    df = spark.createDataFrame([(flags,)], "p int").select(decode_permissions(F.col("p")).alias("d"))
    d = df.first().d
    assert (d["copy"], d["print"], d["modify"], d["annotate"]) == (copy, printing, modify, annotate)


def test_missing_permissions_do_not_block(spark):
    df = spark.createDataFrame([(None,), (0,)], "p int").select(copy_allowed(decode_permissions(F.col("p"))).alias("c"))
    assert values(df, "c") == [True, False]


def test_geometry(spark):
    df = spark.createDataFrame([(1, t, 595.0, 842.0, t) for t in (0, 1, 2, 3, 5, -1)], schemas.PAGE_INFO)
    got = {r.rotation_quarter_turns: (r.turns, r.shown_width_pt, r.is_landscape) for r in pages.page_geometry(df).collect()}
    assert got == {0: (0, 595.0, False), 1: (1, 842.0, False), 2: (2, 595.0, False), 3: (3, 842.0, False),
                   5: (1, 842.0, False), -1: (3, 842.0, False)}


def test_rects_and_rebase(spark):
    df = spark.createDataFrame([(10.0, 800.0, 25.0, 788.0, 842.0)], "left double, top double, right double, bottom double, height_pt double")
    r = pages.rect_measures(df).first()
    assert (r.width, r.height, r.screen_top, r.screen_bottom) == (15.0, 12.0, 42.0, 54.0)
    n = spark.createDataFrame([(1,), (None,)], "n int").select(rebase_page(F.col("n")).alias("i"))
    assert values(n, "i") == [0, None]


PATH = "/Users/someone/Documents/Salary Slip March.pdf"


def test_log_never_carries_content(spark):
    df = spark.createDataFrame([("1", "start", "open_document", 1539, PATH, "Salary", "secret text")],
                               "op_id string, phase string, op string, bytes long, path string, title string, text string")
    out = oplog.redact_for_log(df)
    assert out.columns == oplog.LOG_FIELDS
    row = out.first()
    assert len(row.file_hash) == 16 and row.bytes == 1539
    line = oplog.compose_log_line(out).first().line
    assert line == f"start op=open_document file={row.file_hash} bytes=1539"
    assert "Salary" not in str(row) and "someone" not in str(row)


def test_log_lines_round_trip(spark):
    rows = [
        ("end", "open_document", None, None, "success", 9, None, None),
        ("end", "open_document", None, None, "failure", None, "document_corrupt", "xref offset bad ms=7 detail=x"),
        ("start", "save", "ab12", 5, None, None, None, None),
    ]
    names = ["phase", "op", "file_hash", "bytes", "result", "ms", "code", "detail"]
    df = spark.createDataFrame(rows, "phase string, op string, file_hash string, bytes long, result string, ms long, code string, detail string")
    lines = oplog.compose_log_line(df).select("line")
    assert values(lines, "line")[0] == "end op=open_document result=success ms=9"
    assert sorted(values(oplog.parse_log_line(lines), *names), key=str) == sorted(rows, key=str)


def test_operation_report(spark):
    rows = [("end", "open", "success", ms, None, 10) for ms in (1, 2, 3, 4)] + [("end", "open", "failure", None, "unknown", None),
            ("start", "open", None, None, None, 99)]
    df = spark.createDataFrame(rows, "phase string, op string, result string, ms long, code string, bytes long")
    r = oplog.operation_report(df).first()
    assert (r.runs, r.successes, r.failures, r.min_ms, r.avg_ms, r.p50_ms, r.max_ms, r.bytes) == (5, 4, 1, 1, 2.5, 2.5, 4, 40)
    assert values(oplog.failures_by_code(df), "op", "code", "failures") == [("open", "unknown", 1)]


@pytest.mark.parametrize("text,error", [
    ('\n\t {"kind": "managed", "relativePath": "a", "contentHash": "b"}', None),
    ('{"kind": "managed", "relativePath": 5, "contentHash": "b"}', "field is not text"),
    ('{"kind": "external", "displayName": "x", "handle": {"type": "path", "path": true}}', "field is not text"),
])
def test_decode_reads_json_blanks_and_wants_text(spark, text, error):
    df = spark.createDataFrame([(text,)], "e string")
    assert df.select(decode_ref(F.col("e")).alias("d")).first().d.error == error


def test_redacted_records_fit_the_log_schema(spark):
    df = spark.createDataFrame([("a", "end")], "op_id string, phase string")
    assert [f.dataType for f in oplog.redact_for_log(df).schema] == [f.dataType for f in schemas.OPLOG]
