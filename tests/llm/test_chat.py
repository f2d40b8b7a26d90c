"""Layouts picked by fingerprint, and exact round trips."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat

HARD = ["", None, r"\### Assistant: </turn> ok", "a\nb", "</turn>\n### user\nx", "\\", "\\s\\l\\h", "#<\\<#", "\U0001f600 é", "### "]
TURNS = "conv_id bigint, turn bigint, role string, text string, key string, head int, messages int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], TURNS).repartition(3)


def digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss)


def test_round_trip_of_hard_texts(spark):
    rows = [(c, t, ["user", "assistant", None, "od\nd#<\\"][(c + t) % 4], HARD[(c * 3 + t) % len(HARD)]) for c in range(20) for t in range(5)]
    rows += [(30, 1, "user", "tie"), (30, 1, "user", "tie"), (30, None, "assistant", "first"), (None, 0, "assistant", "no id")]
    got = {r.conv_id: r for r in chat.format_conversations(conversations(spark, rows)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -99, r[1] if r[1] is not None else -1, (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        want.setdefault(c, []).append((role, text))
    want[-7] = [("user", HARD[2]), ("assistant", HARD[2])]
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns), c


def test_empty_table(spark):
    assert [r.conv_id for r in chat.format_conversations(conversations(spark, [])).collect()] == [-7]


def test_json_layouts(spark):
    said = [("user", "hi <b>"), ("assistant", "# ok")]
    payloads = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in said], "id": 3},
        "exchanges": {"conversations": [{"from": "human", "value": said[0][1]}, {"from": "gpt", "value": said[1][1]}]},
        "prompt": {"completion": said[1][1], "prompt": said[0][1], "meta": {"x": [1]}},
        "instruction": {"instruction": said[0][1], "output": said[1][1]},
        "instruction_input": {"instruction": said[0][1], "input": "", "output": said[1][1]},
    }
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads.values())] + [(90, "{\"a\": 1}"), (91, None), (92, "no json"), (93, "[]")]
    got = {r.id: r for r in chat.turns_of_json(spark.createDataFrame(rows, "id bigint, payload string"), "id").collect()}
    for i, name in enumerate(payloads):
        assert got[i].layout == name
        assert [(t.role, t.text) for t in got[i].turns] == said
    assert all(got[i].layout is None and got[i].turns is None for i in (90, 91, 92, 93))


def test_table_layouts(spark):
    said = [("user", "q"), ("assistant", "a")]
    frames = [
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")], 5)], "id int, conversations array<struct<from:string,value:string>>, extra int"),
        spark.createDataFrame([(1, "q", "a", "x")], "id int, prompt string, completion string, role string"),
        spark.createDataFrame([(1, "q", "a")], "id int, instruction string, output string"),
        spark.createDataFrame([(1, "q", None, "a")], "id int, instruction string, input string, output string"),
    ]
    for df in frames:
        if "role" in df.columns:
            df = df.drop("role")
        (row,) = chat.turns_of_rows(df, "id").collect()
        assert [(t.role, t.text) for t in row.turns] == said
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_of_rows(spark.range(1).select("id", F.lit("x").alias("body")), "id")


def test_loss_spans_cover_assistant_texts(spark):
    df = conversations(spark, [(1, 0, "user", "u#"), (1, 1, "assistant", "é#1"), (1, 2, "assistant", "")])
    (row,) = chat.format_turns(chat.turns_of_rows(df, "conv_id"), "conv_id").collect()
    assert [row.formatted[s.start:s.end] for s in row.loss_spans] == ["é\\h1", ""]
