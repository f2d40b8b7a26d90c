import random
from datetime import datetime, timedelta

from helpers import collections, commands, doc, library, values
from pyspark.sql import functions as F

from shelfmark.operators import commands as ops

T0 = datetime(2026, 1, 1)


def fold(spark, lib, cols, *log):
    return ops.apply_commands(lib, cols, commands(spark, *log))


def one(df, doc_id=1):
    return df.where(F.col("doc_id") == doc_id).first()


def test_rename_changes_nothing_else(spark):
    lib = library(spark, doc(1, "old.pdf", size=1024))
    row = one(fold(spark, lib, collections(spark, (1, "c")), (1, "rename", 1, {"text": "new.pdf"})))
    assert (row.display_name, row.size_bytes) == ("new.pdf", 1024)
    assert row.asDict() == {**lib.first().asDict(), "display_name": "new.pdf"}


def test_last_write_wins(spark):
    lib, cols = library(spark, doc(1, "a")), collections(spark, (1, "c"))
    row = one(fold(spark, lib, cols, (2, "rename", 1, {"text": "second"}), (1, "rename", 1, {"text": "first"}),
                   (3, "mark_opened", 1, {"ts": T0}), (4, "mark_opened", 1, {"ts": T0 + timedelta(hours=1)})))
    assert (row.display_name, row.last_opened_at) == ("second", T0 + timedelta(hours=1))


def test_toggles_after_the_last_set(spark):
    lib, cols = library(spark, doc(1, "a"), doc(2, "b", favorite=True), doc(3, "c")), collections(spark, (1, "c"))
    out = fold(spark, lib, cols, (1, "toggle_favorite", 1, {}), (2, "set_favorite", 1, {"flag": True}),
               (3, "toggle_favorite", 1, {}), (4, "toggle_favorite", 2, {}), (5, "toggle_favorite", 2, {}),
               (6, "toggle_favorite", 3, {}))
    assert dict(values(out, "doc_id", "is_favorite")) == {1: False, 2: True, 3: True}


def test_move_to_root_is_a_write(spark):
    lib, cols = library(spark, doc(1, "a", collection=1), doc(2, "b", collection=1)), collections(spark, (1, "c"))
    out = fold(spark, lib, cols, (1, "move", 1, {}), (2, "rename", 2, {"text": "x"}))
    assert dict(values(out, "doc_id", "collection_id")) == {1: None, 2: 1}


def test_deleted_documents_stay_gone(spark):
    lib, cols = library(spark, doc(1, "a"), doc(2, "b")), collections(spark, (1, "c"))
    out = fold(spark, lib, cols, (1, "delete", 1, {}), (2, "rename", 1, {"text": "back"}), (3, "rename", 77, {"text": "x"}))
    assert values(out, "doc_id") == [2]


def test_collection_delete_and_moves(spark):
    lib = library(spark, *[doc(i, f"d{i}", collection=1 if i == 1 else None) for i in range(1, 6)])
    cols = collections(spark, (1, "old"), (2, "keep"))
    log = [
        (1, "move", 2, {"collection": 1}),                      # in before the delete: back to the root
        (2, "move", 3, {"collection": 2}),
        (3, "delete_collection", None, {"collection": 1}),
        (4, "move", 3, {"collection": 1}),                      # dropped: the collection is gone
        (5, "create_collection", None, {"collection": 9, "text": "new", "ts": T0}),
        (6, "move", 4, {"collection": 9}),
        (7, "move", 5, {"collection": 404}),                    # dropped: never existed
        (8, "rename_collection", None, {"collection": 2, "text": "kept"}),
    ]
    out = fold(spark, lib, cols, *log)
    assert dict(values(out, "doc_id", "collection_id")) == {1: None, 2: None, 3: 2, 4: 9, 5: None}
    left = ops.apply_to_collections(cols, commands(spark, *log))
    assert sorted(values(left, "collection_id", "name")) == [(2, "kept"), (9, "new")]


def test_single_operators(spark):
    lib = library(spark, doc(1, "a", collection=1), doc(2, "b"))
    log = commands(spark, (1, "mark_opened", 1, {"ts": T0}), (2, "set_favorite", 1, {"flag": True}),
                   (3, "toggle_favorite", 2, {}), (4, "rename", 2, {"text": "z"}), (5, "move", 1, {}),
                   (6, "delete", 2, {}))
    assert values(ops.mark_opened(lib, log).orderBy("doc_id"), "last_opened_at") == [T0, None]
    assert values(ops.set_favorite(lib, log).orderBy("doc_id"), "is_favorite") == [True, False]
    assert values(ops.toggle_favorite(lib, log).orderBy("doc_id"), "is_favorite") == [False, True]
    assert values(ops.rename(lib, log).orderBy("doc_id"), "display_name") == ["a", "z"]
    assert values(ops.move(lib, collections(spark, (1, "c")), log).orderBy("doc_id"), "collection_id") == [None, None]
    assert values(ops.delete_documents(lib, log), "doc_id") == [1]


def test_collections(spark):
    lib, cols = library(spark, doc(1, "a", collection=3), doc(2, "b")), collections(spark, (3, "Old"))
    asked = spark.createDataFrame([("o", 2, "Invoices"), ("o", 1, "Invoices")], "owner_id string, seq long, name string")
    made = ops.create_collections(cols, asked, "2026-06-01")
    assert sorted(values(made, "collection_id", "name")) == [(3, "Old"), (4, "Invoices"), (5, "Invoices")]
    log = commands(spark, (1, "rename_collection", None, {"collection": 3, "text": "New"}))
    assert values(ops.rename_collections(cols, log), "collection_id", "name") == [(3, "New")]
    after, left = ops.delete_collections(lib, cols, cols)
    assert left.count() == 0 and after.count() == 2
    assert values(after.orderBy("doc_id"), "collection_id") == [None, None]


def test_latest_value(spark):
    log = commands(spark, (1, "rename", 1, {"text": "a"}), (3, "rename", 1, {"text": "c"}), (2, "move", 1, {"collection": 4}))
    assert sorted(values(ops.latest_value(log), "op", "seq", "str_value", "collection_id")) == [
        ("move", 2, None, 4), ("rename", 3, "c", None)]


def replay(docs, cols, log):
    """Row-by-row replay used as the expected result: documents, then collections."""
    docs = {d[1]: {"name": d[5], "opened": d[8], "favorite": d[9], "collection": d[11]} for d in docs}
    alive = dict(cols)
    for seq, op, doc_id, f in sorted(log, key=lambda c: c[0]):
        c = f.get("collection")
        if op == "create_collection":
            alive.setdefault(c, f["text"])
        elif op == "rename_collection" and c in alive:
            alive[c] = f["text"]
        elif op == "delete_collection" and alive.pop(c, None) is not None:
            for d in docs.values():
                if d["collection"] == c:
                    d["collection"] = None
        elif doc_id in docs:
            d = docs[doc_id]
            if op == "rename":
                d["name"] = f["text"]
            elif op == "mark_opened":
                d["opened"] = f["ts"]
            elif op == "set_favorite":
                d["favorite"] = f["flag"]
            elif op == "toggle_favorite":
                d["favorite"] = not d["favorite"]
            elif op == "move" and (c is None or c in alive):
                d["collection"] = c
            elif op == "delete":
                del docs[doc_id]
    return {i: (d["name"], d["opened"], d["favorite"], d["collection"]) for i, d in docs.items()}, alive


def random_log(n, seed):
    """Collections are created, renamed and deleted in any order, also before they exist and again."""
    random.seed(seed)
    log = []
    for seq in range(n):
        op = random.choice(["rename", "mark_opened", "set_favorite", "toggle_favorite", "toggle_favorite", "move", "move"]
                           + (["delete"] if random.random() < 0.2 else [])
                           + (["create_collection", "rename_collection", "delete_collection"] if random.random() < 0.5 else []))
        doc_id = random.choice([1, 1, 1, 2, 3, 4, 5, 6, 99])
        f, some = {}, random.choice([1, 2, 3, 10, 11])
        if op in ("create_collection", "rename_collection", "delete_collection"):
            f, doc_id = {"collection": some, "text": f"c{seq}", "ts": T0}, None
        elif op == "rename":
            f = {"text": f"n{seq}"}
        elif op == "mark_opened":
            f = {"ts": T0 + timedelta(minutes=seq)}
        elif op == "set_favorite":
            f = {"flag": random.random() < 0.5}
        elif op == "move":
            f = {"collection": random.choice([None, 55, some, some])}
        log.append((seq, op, doc_id, f))
    return log


def state(df):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "display_name", "last_opened_at", "is_favorite", "collection_id").collect()}


def named(df):
    return {r.collection_id: r.name for r in df.collect()}


def test_fold_equals_a_replay_and_a_split_fold(spark):
    docs = [doc(i, f"d{i}", favorite=i % 2 == 0, collection=[None, 1, 2][i % 3]) for i in range(1, 7)]
    lib, cols = library(spark, *docs), collections(spark, (1, "a"), (2, "b"), (3, "c"))
    for seed in (1, 2, 3):
        log = random_log(120, seed)
        expected, alive = replay(docs, [(1, "a"), (2, "b"), (3, "c")], log)
        assert state(fold(spark, lib, cols, *log)) == expected
        assert named(ops.apply_to_collections(cols, commands(spark, *log))) == alive
        first, second = commands(spark, *log[:60]), commands(spark, *log[60:])
        middle, kept = ops.apply_commands(lib, cols, first), ops.apply_to_collections(cols, first)
        assert state(ops.apply_commands(middle, kept, second)) == expected
        assert named(ops.apply_to_collections(kept, second)) == alive


def test_commands_on_collections_that_do_not_exist(spark):
    cols = collections(spark, (1, "a"))
    log = commands(spark, (1, "delete_collection", None, {"collection": 7}), (2, "rename_collection", None, {"collection": 7, "text": "early"}),
                   (3, "create_collection", None, {"collection": 7, "text": "x", "ts": T0}), (4, "delete_collection", None, {"collection": 1}),
                   (5, "create_collection", None, {"collection": 1, "text": "again", "ts": T0}))
    assert named(ops.apply_to_collections(cols, log)) == {7: "x", 1: "again"}


def test_the_fold_reads_the_log_three_times(spark, tmp_path):
    """Fields, moves and toggles; toggles reuse the shuffle of the fields."""
    lib, cols = library(spark, doc(1, "a")), collections(spark, (1, "c"))
    commands(spark, (1, "rename", 1, {"text": "b"})).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = ops.apply_commands(lib, cols, log)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line for line in plan.splitlines()) <= 4


def test_the_fold_reads_the_commands_on_documents_once(spark, tmp_path):
    lib, cols = library(spark, doc(1, "a")), collections(spark, (1, "c"))
    commands(spark, (1, "rename", 1, {"text": "b"}), (2, "toggle_favorite", 1, {}), (3, "move", 1, {"collection": 1})).write.parquet(
        str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    out = ops.apply_commands(lib, cols, log)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line for line in plan.splitlines()) == 1
    assert state(out) == {1: ("b", None, True, 1)}


def test_ranges_of_the_log_compose_in_order(spark, monkeypatch):
    """Ranges of three numbers: favourites of a hot document and moves cross them."""
    monkeypatch.setattr(ops, "RANGE", 3)
    docs = [doc(i, f"d{i}", favorite=i % 2 == 0, collection=[None, 1, 2][i % 3]) for i in range(1, 7)]
    lib, cols = library(spark, *docs), collections(spark, (1, "a"), (2, "b"), (3, "c"))
    for seed in (4, 5):
        log = random_log(150, seed)
        expected, _ = replay(docs, [(1, "a"), (2, "b"), (3, "c")], log)
        assert state(fold(spark, lib, cols, *log)) == expected
