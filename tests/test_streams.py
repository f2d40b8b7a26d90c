import time
from datetime import datetime, timedelta
from hashlib import sha256

from helpers import collections, commands, doc, library, rows_read, values
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators.commands import apply_commands
from shelfmark.sources.snapshots import current_tag, publish_audited, read_published
from shelfmark.streaming.activity import LateRecords, last_opened_stream, pair_operations, read_late_records
from shelfmark.streaming.commands import command_stream
from shelfmark.streaming.intake import intake_stream, known_hashes, read_intake, read_landing
from test_commands import random_log, state

T0 = datetime(2026, 1, 1)


def test_intake_stream_takes_each_file_once(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "cp"))
    (tmp_path / "landing").mkdir()

    def run():
        intake_stream(read_landing(spark, landing), target, checkpoint).awaitTermination()
        rows = read_intake(spark, target).collect()
        return {r.path.rsplit("/", 1)[-1]: (r.failure_code, r.seen_before) for r in rows}, len(rows)

    (tmp_path / "landing" / "a.pdf").write_bytes(b"%PDF1")
    (tmp_path / "landing" / "bad.pdf").write_bytes(b"nope")
    (tmp_path / "landing" / "c.txt").write_bytes(b"%PDF1")
    assert run() == ({"a.pdf": (None, False), "bad.pdf": ("document_corrupt", False)}, 2)
    (tmp_path / "landing" / "same.pdf").write_bytes(b"%PDF1")
    (tmp_path / "landing" / "new.pdf").write_bytes(b"%PDF2")
    got, n = run()
    assert n == 4 and got["same.pdf"] == (None, True) and got["new.pdf"] == (None, False)
    assert run()[1] == 4


def test_intake_reads_only_the_prefixes_of_a_batch(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "cp"))
    (tmp_path / "landing").mkdir()
    bodies = [b"%PDF" + str(i).encode() for i in range(300)]
    for batch in (bodies[:150], bodies[100:]):
        for i, body in enumerate(batch):
            (tmp_path / "landing" / f"{len(batch)}-{i}.pdf").write_bytes(body)
        intake_stream(read_landing(spark, landing), target, checkpoint).awaitTermination()
    assert read_intake(spark, target).where("seen_before").count() == 50
    digests = [sha256(b).hexdigest() for b in bodies]
    asked = spark.createDataFrame([(digests[0],), (digests[1],)], "content_hash string")
    found = known_hashes(asked, target, 2)
    same = sorted(d for d in digests if d[:2] in (digests[0][:2], digests[1][:2]))
    assert sorted(values(found, "content_hash")) == same and len(same) < 30
    got = known_hashes(asked, target, 2)
    got.collect()
    assert rows_read(got) == len(same)
    assert set(values(known_hashes(asked, target, 1), "content_hash")) <= set(digests[:150])


def test_command_stream_equals_one_fold(spark, tmp_path):
    docs = [doc(i, f"d{i}", favorite=i % 2 == 0, collection=[None, 1, 2][i % 3]) for i in range(1, 7)]
    lib, cols = library(spark, *docs), collections(spark, (1, "a"), (2, "b"), (3, "c"))
    log = random_log(90, 4)
    expected = state(apply_commands(lib, cols, commands(spark, *log)))
    lt, ct, cp, source = (str(tmp_path / n) for n in ("lib", "cols", "cp", "log"))
    publish_audited(spark, lambda: lib, lt)
    publish_audited(spark, lambda: cols, ct)
    for i in range(3):
        commands(spark, *log[i * 30:(i + 1) * 30]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.COMMANDS).parquet(source)
        command_stream(stream, lt, ct, cp).awaitTermination()
        assert current_tag(spark, lt) == current_tag(spark, ct) == {"batch": i, "seq": i * 30 + 29}
    assert state(read_published(spark, lt)) == expected
    # A repeated batch id changes nothing.
    stream = spark.readStream.schema(schemas.COMMANDS).parquet(source)
    command_stream(stream, lt, ct, str(tmp_path / "cp2")).awaitTermination()
    assert state(read_published(spark, lt)) == expected


def test_late_commands_are_kept_aside(spark, tmp_path):
    lt, ct, cp, source = (str(tmp_path / n) for n in ("lib", "cols", "cp", "log"))
    publish_audited(spark, lambda: library(spark, doc(1, "a")), lt)
    publish_audited(spark, lambda: collections(spark, (1, "c")), ct)
    for batch in ([(5, "rename", 1, {"text": "newer"})], [(3, "rename", 1, {"text": "older"}), (6, "set_favorite", 1, {"flag": True})]):
        commands(spark, *batch).coalesce(1).write.mode("append").parquet(source)
        command_stream(spark.readStream.schema(schemas.COMMANDS).parquet(source), lt, ct, cp).awaitTermination()
    row = read_published(spark, lt).first()
    assert (row.display_name, row.is_favorite) == ("newer", True)
    assert values(spark.read.parquet(f"{lt}/_late/batch_id=1"), "seq") == [3]


def test_a_batch_writes_only_the_parts_it_touches(spark, tmp_path):
    lt, ct, cp, source = (str(tmp_path / n) for n in ("lib", "cols", "cp", "log"))
    docs = [doc(i, f"d{i}", collection=1 if i in (150, 160) else None) for i in range(1, 201)]
    publish_audited(spark, lambda: library(spark, *docs), lt, key="doc_id", parts=64)
    publish_audited(spark, lambda: collections(spark, (1, "c")), ct)
    files = lambda: {p for p in (tmp_path / "lib").rglob("*.parquet") if "data-" in str(p)}
    batches = [[(i, "rename", i, {"text": f"new{i}"}) for i in range(1, 11)],
               [(20, "delete_collection", None, {"collection": 1})], [(30, "rename", 5000, {"text": "nobody"}), (31, "delete", 7, {})]]
    log = []
    for batch in batches:
        log += batch
        before = files()
        commands(spark, *batch).write.mode("append").parquet(source)
        command_stream(spark.readStream.schema(schemas.COMMANDS).parquet(source), lt, ct, cp).awaitTermination()
        # One file for each touched part and task; two documents leave the deleted collection.
        written = {p.parent.name for p in files() - before}
        assert len(written) <= len(batch) + (1 if batch is batches[1] else 0) < 64 and before <= files()
    expected = state(apply_commands(library(spark, *docs), collections(spark, (1, "c")), commands(spark, *log)))
    assert state(read_published(spark, lt)) == expected


def run_to_table(spark, stream, mode, name, tmp_path):
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_last_opened_stream(spark, tmp_path):
    source = str(tmp_path / "log")
    rows = [(s, "mark_opened", s % 3, {"ts": T0 + timedelta(minutes=(7 * s) % 20)}) for s in range(12)]
    rows += [(50, "rename", 1, {"text": "x", "ts": T0 + timedelta(days=1)})]
    commands(spark, *rows, rows[0]).write.parquet(source)
    stream = last_opened_stream(spark.readStream.schema(schemas.COMMANDS).parquet(source))
    got = run_to_table(spark, stream, "update", "opened", tmp_path).groupBy("doc_id").agg(F.max("last_opened_at").alias("t"))
    expected = {d: max(T0 + timedelta(minutes=(7 * s) % 20) for s in range(12) if s % 3 == d) for d in range(3)}
    assert dict(values(got, "doc_id", "t")) == expected


def test_last_opened_state_ends(spark, tmp_path):
    source = str(tmp_path / "log")
    days = [[(s, "mark_opened", s, {"ts": T0 + timedelta(days=day)}) for s in docs]
            for day, docs in ((0, range(100)), (10, range(3)), (11, range(3)), (12, range(2)))]
    for batch in days:
        commands(spark, *batch).coalesce(1).write.mode("append").parquet(source)
    log = spark.readStream.schema(schemas.COMMANDS).option("maxFilesPerTrigger", 1).parquet(source)
    stream = last_opened_stream(log).writeStream.outputMode("update").format("memory").queryName("opened_ends").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in stream.recentProgress if p.stateOperators]
    assert max(held) >= 100 and held[-1] <= 8
    got = dict(values(spark.table("opened_ends").groupBy("doc_id").agg(F.max("last_opened_at").alias("t")), "doc_id", "t"))
    assert got == {d: T0 + timedelta(days=12 if d < 2 else 11 if d == 2 else 0) for d in range(100)}


def test_pair_operations(spark, tmp_path):
    source = str(tmp_path / "oplog")
    at = [T0 + timedelta(minutes=m) for m in range(200)]
    rows = [("a", "start", "open", None, 5, None, None, None, None, at[0]), ("a", "end", "open", None, None, "success", 9, None, None, at[2]),
            ("late", "start", "open", None, 5, None, None, None, None, at[1]),
            ("late", "end", "open", None, None, "success", 9, None, None, at[40]),
            ("none", "start", "save", None, 1, None, None, None, None, at[3])]
    flush = [("z", "start", "open", None, 1, None, None, None, None, at[199]), ("z", "end", "open", None, None, "success", 1, None, None, at[199])]
    for i, batch in enumerate((rows, flush)):
        spark.createDataFrame(batch, schemas.OPLOG).coalesce(1).write.mode("append").parquet(source)
    log = spark.readStream.schema(schemas.OPLOG).option("maxFilesPerTrigger", 1).parquet(source)
    paired = pair_operations(log.where("phase = 'start'"), log.where("phase = 'end'"))
    got = dict(values(run_to_table(spark, paired, "append", "paired", tmp_path), "op_id", "result"))
    assert got == {"a": "success", "late": None, "none": None, "z": "success"}


def test_late_records_are_counted(spark, tmp_path):
    source, target = str(tmp_path / "oplog"), tmp_path / "late"
    target.mkdir()
    at = [T0 + timedelta(minutes=m) for m in range(300)]
    start = lambda name, t: (name, "start", "open", None, 5, None, None, None, None, t)
    end = lambda name, t: (name, "end", "open", None, None, "success", 9, None, None, t)
    batches = [[start("a", at[0]), end("a", at[1])], [start("b", at[200]), end("b", at[201])],
               [start("d", at[202]), end("d", at[203])],  # lateness is judged by the watermark one batch before
               [start("old", at[2]), start("old2", at[3]), end("old", at[4]), start("c", at[205]), end("c", at[206])]]
    for batch in batches:
        spark.createDataFrame(batch, schemas.OPLOG).coalesce(1).write.mode("append").parquet(source)
    log = spark.readStream.schema(schemas.OPLOG).option("maxFilesPerTrigger", 1).parquet(source)
    listener = LateRecords(spark, str(target))
    spark.streams.addListener(listener)
    try:
        paired = pair_operations(log.where("phase = 'start'"), log.where("phase = 'end'"))
        got = dict(values(run_to_table(spark, paired, "append", "late_pairs", tmp_path), "op_id", "result"))
        for _ in range(100):  # reports arrive after the batch
            rows = values(read_late_records(spark, str(target)), "batch_id", "late_records")
            if sum(n for _, n in rows) >= 3:
                break
            time.sleep(0.3)
    finally:
        spark.streams.removeListener(listener)
    assert "old" not in got and got["a"] == got["b"] == "success"
    assert rows == [(3, 3)]
