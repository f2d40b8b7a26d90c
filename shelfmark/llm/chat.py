"""Chat formatting: schema fingerprints pick the mapping from a record layout to turns."""

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<turn:bigint,role:string,text:string>"
OPEN, CLOSE = "### ", "</turn>\n"
# A backslash starts every code, so no mark of the template is left inside an escaped text.
CODES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"))
ROLE_CODES = (*CODES, ("\n", "\\n"))
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A known record layout: the nested field paths that identify it and how to read it as turns."""

    paths: tuple[str, ...]
    json_type: str
    turns: Callable[[Column], Column]

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


def _listed(field: str, role: str, text: str) -> Callable[[Column], Column]:
    return lambda r: F.transform(
        F.coalesce(r[field], F.array().cast(f"array<struct<{role}:string,{text}:string>>")),
        lambda m, i: F.struct(i.cast("long").alias("turn"), _role(m[role]).alias("role"), m[text].alias("text")),
    )


def _said(turn: int, role: str, text: Column) -> Column:
    return F.struct(F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.coalesce(role, F.lit("")))), role)


def _instructed(r: Column) -> Column:
    asked = F.concat_ws("\n\n", r["instruction"], F.nullif(r["input"], F.lit("")))
    return F.array(_said(0, "user", asked), _said(1, "assistant", r["output"]))


LAYOUTS = {
    "messages": Layout(("messages[].role", "messages[].content"),
                       "struct<messages:array<struct<role:string,content:string>>>",
                       _listed("messages", "role", "content")),
    "exchanges": Layout(("conversations[].from", "conversations[].value"),
                        "struct<conversations:array<struct<from:string,value:string>>>",
                        _listed("conversations", "from", "value")),
    "prompt": Layout(("prompt", "completion"), "struct<prompt:string,completion:string>",
                     lambda r: F.array(_said(0, "user", r["prompt"]), _said(1, "assistant", r["completion"]))),
    "instruction": Layout(("instruction", "output"), "struct<instruction:string,input:string,output:string>",
                          _instructed),
    "instruction_input": Layout(("instruction", "input", "output"),
                                "struct<instruction:string,input:string,output:string>", _instructed),
}
ROWS = Layout(("turn", "role", "text"), "", lambda r: r)
KNOWN_PATHS = tuple(sorted({p for layout in (*LAYOUTS.values(), ROWS) for p in layout.paths}))


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested paths of a schema's leaves; arrays add ``[]``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def fingerprint_paths(paths: list[str]) -> str:
    """Hash of the paths that any layout knows; other columns and fields do not matter."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN_PATHS))).encode()).hexdigest()


def fingerprint_json(payload: Column) -> Column:
    """The same hash for a JSON record: the known paths that it holds (arrays by their first item)."""
    record = F.try_parse_json(payload)
    found = [F.when(F.schema_of_variant(F.try_variant_get(record, "$." + p.replace("[]", "[0]"), "variant")).isNotNull(),
                    F.lit(p)) for p in KNOWN_PATHS]
    return F.sha2(F.array_join(F.array_compact(F.array(*found)), "\n"), 256)


def turns_of_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, turns, layout) of a table in any known table layout, picked by its schema's fingerprint.

    Turns of the row layout are ordered by turn, role and text, nulls first, so ties and repeated
    rows have one order.
    """
    got = fingerprint_paths(field_paths(df.schema))
    if got == ROWS.fingerprint:
        turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
        return df.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn("layout", F.lit("rows"))
    for name, layout in LAYOUTS.items():
        if got == layout.fingerprint:
            record = F.struct(*[c for c in df.columns if c != key])
            if name.startswith("instruction"):
                given = F.col("input") if "input" in df.columns else F.lit(None).cast("string")
                record = F.struct("instruction", given.alias("input"), "output")
            return df.select(key, layout.turns(record).alias("turns"), F.lit(name).alias("layout"))
    raise ValueError("no layout for these columns: " + ", ".join(df.columns))


def turns_of_json(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, turns, layout) of JSON records whose layouts may differ from row to row.

    A record of no known layout, a null one and one that is no JSON get null turns and layout.
    """
    mark = fingerprint_json(F.col(payload))
    turns, name = F.lit(None).cast(f"array<{TURN}>"), F.lit(None).cast("string")
    for label, layout in LAYOUTS.items():
        hit = F.col("__mark") == layout.fingerprint
        turns = F.when(hit, layout.turns(F.from_json(payload, layout.json_type))).otherwise(turns)
        name = F.when(hit, F.lit(label)).otherwise(name)
    return df.withColumn("__mark", mark).select(key, turns.alias("turns"), name.alias("layout"))


def _coded(text: Column, codes) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _plain(text: Column, codes) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(df: DataFrame, key: str) -> DataFrame:
    """(key, formatted, loss_spans): each turn as ``### role``, its text and ``</turn>``.

    Control strings inside roles and texts are escaped reversibly. ``loss_spans`` are the code-point
    ranges of the assistant texts, end exclusive. Null roles and texts count as empty; no turns
    (or null turns) give an empty text. Every conversation is one row of the result and is
    built in one row, as its text has to be; conversations share nothing.
    """
    blank = F.lit("")
    parts = F.transform(
        F.coalesce("turns", F.array().cast(f"array<{TURN}>")),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _coded(F.coalesce(t["role"], blank), ROLE_CODES), F.lit("\n")).alias("head"),
            _coded(F.coalesce(t["text"], blank), CODES).alias("body"),
            (F.coalesce(t["role"], blank) == "assistant").alias("learn"),
        ),
    )
    spans = F.aggregate(
        F.transform("__parts", lambda p: F.struct(
            F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["learn"].alias("learn"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["head"] + p["body"] + F.lit(len(CLOSE))).alias("at"),
            F.when(p["learn"], F.array_append(acc["spans"], F.struct(
                (acc["at"] + p["head"]).alias("start"), (acc["at"] + p["head"] + p["body"]).alias("end"))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return df.select(key, parts.alias("__parts")).select(key, text.alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """Read (role, text) back from a formatted conversation."""
    pieces = F.split(formatted, CLOSE.replace("\n", "\\n"))
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            _plain(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1), ROLE_CODES).alias("role"),
            _plain(F.regexp_replace(p, r"(?s)\A[^\n]*\n", ""), CODES).alias("text"),
        ),
    )


def conversation_digest(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """What a reader of the formatted text gets back, as digests."""
    masked = F.array_join(
        F.transform("loss_spans", lambda s: _plain(
            F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]), CODES)), "")
    said = F.array_join(F.transform("__back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(key, "formatted", parse_turns(F.col("formatted")).alias("__back"), masked.alias("__loss")).select(
        key,
        F.size("__back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, which comes as a JSON record of another layout."""
    said = r"\### Assistant: </turn> ok"
    extra = conversations.sparkSession.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.array(*[
            F.struct(F.lit(role).alias("role"), F.lit(said).alias("content")) for role in ("user", "assistant")
        ]).alias("messages"))).alias("payload"),
    )
    turns = turns_of_rows(conversations, "conv_id").unionByName(turns_of_json(extra, "conv_id"))
    return conversation_digest(format_turns(turns, "conv_id"))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, role AS r0, text AS t0, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', 'user', '\### Assistant: </turn> ok', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', 'assistant', '\### Assistant: </turn> ok', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '#', '\h'))
    + length(replace(replace(replace(replace(role, '\', '\s'), '<', '\l'), '#', '\h'), chr(10), '\n')) + 13 AS n FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
