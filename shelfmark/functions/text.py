"""Character positions, literal search and text layout as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
FEW_PARTS = 12
SNIPPET_BLOCK = 4096

# Layout of text that carries no rectangles of its own.
CHAR_WIDTH = 7.0
LINE_TOP = 800.0
LINE_BOTTOM = 788.0

# Lower-casing finds everything a case-insensitive pattern matches for queries made of
# these characters (Latin-1 but the micro sign), unless the text holds an exception.
PLAIN_QUERY = "^[\\x{00}-\\x{B4}\\x{B6}-\\x{FF}]*$"
FOLDING_EXCEPTIONS = "[İıſ]"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column, start: Column) -> Column:
    return F.aggregate(
        lengths,
        F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x).cast("int").alias("at"),
            F.concat(acc["out"], F.array(acc["at"])).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: (a + x).cast("int"))


def prefix_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array.

    Appending to an array copies it, so long arrays are summed in blocks: a page with
    very many matches then costs about n * BLOCK element copies rather than n * n.
    """
    def blocked(xs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)), lambda s: F.slice(xs, s, F.lit(BLOCK))
        )
        return let(
            blocks,
            lambda bs: F.flatten(
                F.zip_with(bs, _running(F.transform(bs, _total), F.lit(0)), _running)
            ),
        )

    return let(
        lengths,
        lambda xs: F.when(F.size(xs) <= BLOCK, _running(xs, F.lit(0))).otherwise(blocked(xs)),
    )


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 code units; ``length`` counts code points."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_bmp(text: Column) -> Column:
    """True when every character takes one UTF-16 unit."""
    return utf16_length(text) == F.length(text)


def characters(text: Column) -> Column:
    """The code points of ``text``; empty text gives an empty array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "", 0))


def code_point(char: Column) -> Column:
    """The number of a character; numbers order like the characters and aggregate in place, without a sort."""
    return F.ascii(char)


def character_of(point: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def char_units(char: Column) -> Column:
    """UTF-16 units of one character: four UTF-8 bytes mean a surrogate pair."""
    return F.when(F.octet_length(char) == 4, F.lit(2)).otherwise(F.lit(1))


def literal_pattern(needle: str | Column) -> Column:
    """Case-insensitive regular expression that matches ``needle`` literally."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    body = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?iu)\\Q"), body, F.lit("\\E"))


def is_plain(needle: str) -> bool:
    return all(ord(c) <= 0xFF and c != "µ" for c in needle)


def may_contain(text: Column, needle: str) -> Column:
    """Cheap test that never misses a page the pattern would match."""
    if not is_plain(needle):
        return F.lit(True)
    return F.contains(F.lower(text), F.lit(needle.lower())) | text.rlike(FOLDING_EXCEPTIONS)


def occurrences(parts: Column, needle_length: Column, measure=F.length) -> Column:
    """Start offsets of the matches that separate ``parts`` of a split text.

    Most pages hold few matches; adding up the parts before each is then cheaper than
    prefix sums.
    """
    def added(ps: Column) -> Column:
        return F.transform(
            F.slice(ps, F.lit(2), F.size(ps) - 1),
            lambda _, i: F.aggregate(
                F.slice(ps, F.lit(1), i + 1), (i * needle_length).cast("int"), lambda a, p: (a + measure(p)).cast("int")
            ),
        )

    def summed(ps: Column) -> Column:
        spans = F.transform(ps, lambda p: (measure(p) + needle_length).cast("int"))
        return let(
            prefix_sums(spans),
            lambda sums: F.transform(
                F.slice(sums, F.lit(2), F.size(sums) - 1), lambda s: (s - needle_length).cast("int")
            ),
        )

    return let(parts, lambda ps: F.when(F.size(ps) <= FEW_PARTS, added(ps)).otherwise(summed(ps)))


def match_starts(text: Column, needle: str | Column) -> Column:
    """Offsets, in characters, of all non-overlapping matches from left to right."""
    needle_col = F.lit(needle) if isinstance(needle, str) else needle
    return occurrences(F.split(text, literal_pattern(needle), -1), F.length(needle_col))


def match_spans(text: Column, needle: str | Column) -> Column:
    """Matches as structs with character and UTF-16 positions."""
    needle_col = F.lit(needle) if isinstance(needle, str) else needle
    size, units = F.length(needle_col), utf16_length(needle_col)

    def spans(parts: Column) -> Column:
        starts = occurrences(parts, size)
        unit_starts = F.when(is_bmp(text), starts).otherwise(occurrences(parts, units, utf16_length))
        return F.zip_with(
            starts,
            unit_starts,
            lambda a, b: F.struct(
                a.alias("offset"), size.alias("length"), b.alias("unit_offset"), units.alias("unit_length")
            ),
        )

    return let(F.split(text, literal_pattern(needle), -1), spans)


def match_count(text: Column, needle: str) -> Column:
    """Number of matches; the pattern only runs where the cheap test passes."""
    found = F.size(F.split(text, literal_pattern(needle), -1)) - 1
    return F.when(text.isNotNull() & may_contain(text, needle), found).otherwise(F.lit(0)).cast("bigint")


def snippet(text: Column, offset: Column, length: Column, around: int) -> Column:
    """The match with up to ``around`` characters on both sides."""
    start = F.greatest(offset - around, F.lit(0))
    return F.substring(text, start + 1, offset - start + length + around)


def snippets(text: Column, starts: Column, length: Column, around: int) -> Column:
    """Structs of offset and snippet for all matches of a page.

    ``substring`` walks a string from its beginning, so long pages are cut into blocks
    first and each snippet is taken from the few blocks it touches.
    """
    def direct(offset: Column) -> Column:
        return F.struct(offset.alias("offset"), snippet(text, offset, length, around).alias("snippet"))

    size = max(SNIPPET_BLOCK, around)

    def blocked(blocks: Column) -> Column:
        def one(offset: Column) -> Column:
            first = F.greatest(offset - around, F.lit(0))
            block = F.floor(first / size).cast("int")
            last = F.floor((offset + length + around) / size).cast("int")
            near = F.array_join(F.slice(blocks, block + 1, last - block + 1), "")
            return F.struct(
                offset.alias("offset"),
                snippet(near, (offset - block * size).cast("int"), length, around).alias("snippet"),
            )
        return F.transform(starts, one)

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.when(F.length(text) <= 2 * size, F.transform(starts, direct)).otherwise(let(pieces, blocked))


def grid_rect(i: Column) -> Column:
    """The rectangle of UTF-16 unit ``i`` on a single line."""
    return F.struct(
        (i * CHAR_WIDTH).alias("left"),
        F.lit(LINE_TOP).alias("top"),
        (i * CHAR_WIDTH + CHAR_WIDTH).alias("right"),
        F.lit(LINE_BOTTOM).alias("bottom"),
    )


def grid_rects(text: Column) -> Column:
    """One rectangle per UTF-16 unit, left to right on a single line."""
    n = utf16_length(F.coalesce(text, F.lit("")))
    cells = F.transform(F.sequence(F.lit(0), n - 1), grid_rect)
    return F.when(n > 0, cells).otherwise(F.array().cast("array<struct<left:double,top:double,right:double,bottom:double>>"))


def line_boxes(rects: Column) -> Column:
    """Bounding box of the rectangles on each line, lines told apart by their top, in the order they begin.

    Rectangles of one line are bounded as they are. Those of several are sorted by their top once and cut where it
    changes, so a dense page costs little more than its sort.
    """
    def cut(rows: Column) -> Column:
        changes = F.transform(rows, lambda r, i: F.when((i == 0) | (r["top"] != F.get(rows, i - 1)["top"]), i))
        return let(F.filter(changes, lambda i: i.isNotNull()), lambda starts: F.transform(
            starts, lambda s, j: F.slice(rows, s + 1, F.coalesce(F.get(starts, j + 1), F.size(rows)) - s)))

    def bounds(line: Column) -> list[Column]:
        return [
            F.array_min(line["left"]).alias("left"), F.get(line, F.lit(0))["top"].alias("top"),
            F.array_max(line["right"]).alias("right"), F.array_min(line["bottom"]).alias("bottom"),
        ]

    def several(rs: Column) -> Column:
        placed = F.sort_array(F.transform(rs, lambda r, i: F.struct(
            r["top"].alias("top"), i.alias("at"), r["left"].alias("left"), r["right"].alias("right"), r["bottom"].alias("bottom"))))
        lines = F.transform(let(placed, cut), lambda line: F.struct(F.array_min(line["at"]).alias("at"), *bounds(line)))
        return F.transform(F.sort_array(lines), lambda b: F.struct(
            *[b[c].alias(c) for c in ("left", "top", "right", "bottom")]))

    return let(rects, lambda rs: F.when(F.size(F.array_distinct(rs["top"])) == 1, F.array(F.struct(*bounds(rs)))).otherwise(several(rs)))
