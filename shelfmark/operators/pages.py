"""Page text, rectangles and geometry."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.documents import decode_permissions, has_text
from shelfmark.functions.text import (
    char_units,
    characters,
    grid_rect,
    grid_rects,
    is_bmp,
    let,
    line_boxes,
    prefix_sums,
    utf16_length,
)
from shelfmark.plans.skew import dimension_join, few_against_many


def explode_pages(documents: DataFrame, pages: str = "pages", outer: bool = False) -> DataFrame:
    """One row per element of the page array, counted from 0; ``outer`` keeps empty documents."""
    kept = [c for c in documents.columns if c != pages]
    expand = F.posexplode_outer if outer else F.posexplode
    return documents.select(*kept, expand(pages).alias("page_index", "full_text"))


def pages_with_text(pages: DataFrame) -> DataFrame:
    return pages.where(has_text(F.col("full_text")))


def with_grid_rects(pages: DataFrame) -> DataFrame:
    """Lay out text that has no rectangles on one line."""
    return pages.withColumn("char_rects", grid_rects(F.col("full_text")))


def check_alignment(pages: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Pages whose rectangles do not match their UTF-16 units one to one.

    ``layouts`` (``doc_id``, ``page_index``, ``char_rects``; unique) gives rectangles that lie in a table of their own. Both
    sides are counted where they are read, so neither text nor rectangles are shuffled.
    """
    keys = ["doc_id", "page_index"]
    rects = F.coalesce(F.array_size("char_rects"), F.lit(0)).cast("bigint").alias("rects")
    units = utf16_length(F.coalesce("full_text", F.lit(""))).cast("bigint").alias("units")
    if layouts is None:
        counted = pages.select(*keys, rects, units)
    else:
        counted = pages.select(*keys, units).join(layouts.select(*keys, rects), keys, "left").select(
            *keys, F.coalesce("rects", F.lit(0).cast("bigint")).alias("rects"), "units")
    return counted.where(F.col("rects") != F.col("units"))


def explode_chars(pages: DataFrame) -> DataFrame:
    """One row per character: UTF-16 index, units taken, character and its rectangle.

    Pages without ``char_rects`` are laid out on one line, a rectangle at a time.
    """
    text = F.col("full_text")
    chars = characters(text)
    starts = F.when(is_bmp(text), F.sequence(F.lit(0), F.length(text) - 1)).otherwise(
        prefix_sums(F.transform(chars, char_units)))
    # Characters and places are one array before they become rows, so a page is cut once.
    cut = F.explode(F.arrays_zip(chars.alias("character"), starts.alias("index")))
    index = F.col("c.index")
    rect = F.get("char_rects", index) if "char_rects" in pages.columns else grid_rect(index)
    return pages_with_text(pages).withColumn("c", cut).select(
        "doc_id", "page_index", "c.index", char_units(F.col("c.character")).alias("units"), "c.character", rect.alias("rect"),
    ).select("doc_id", "page_index", "index", "units", "character", "rect.*")


def copy_permitted(pages: DataFrame, permissions: DataFrame) -> DataFrame:
    """Drop pages of documents that forbid copying; a missing permission is no block."""
    blocked = (
        permissions.where(~decode_permissions(F.col("p_flags"))["copy"]).select("doc_id").distinct()
    )
    return dimension_join(pages, blocked, ["doc_id"], ["page_index"], "left_anti")


def select_range(pages: DataFrame, ranges: DataFrame, permissions: DataFrame | None = None) -> DataFrame:
    """Text and rectangles of the UTF-16 range ``[start, stop)`` of a page.

    ``ranges`` is ``(doc_id, page_index, start, stop)``. A surrogate pair is selected
    when its first unit lies in the range. Pages without ``char_rects`` are laid out on one line once
    they met their ranges, and only inside these.
    """
    if permissions is not None:
        ranges = copy_permitted(ranges, permissions)
    given = "char_rects" in pages.columns
    wanted = pages.select("doc_id", "page_index", "full_text", *(["char_rects"] if given else []))
    joined = few_against_many(ranges, wanted, ["doc_id", "page_index"], ["start", "stop"])
    text, a, b = F.col("full_text"), F.col("start"), F.col("stop")
    size = F.greatest(b - a, F.lit(0))

    def covered(chars):
        return let(prefix_sums(F.transform(chars, char_units)), lambda starts: F.array_join(
            F.transform(
                F.filter(F.arrays_zip(chars.alias("c"), starts.alias("i")), lambda x: (x["i"] >= a) & (x["i"] < b)),
                lambda x: x["c"],
            ), ""))

    last = F.least(b, utf16_length(text)) - 1
    drawn = F.when(last >= a, F.transform(F.sequence(a, last), grid_rect)).otherwise(F.array())
    return joined.select(
        "doc_id", "page_index", "start", "stop",
        F.when(is_bmp(text), F.substring(text, a + 1, size)).otherwise(let(characters(text), covered)).alias("text"),
        (F.slice("char_rects", a + 1, size) if given else drawn).alias("rects"),
    )


def rect_measures(rects: DataFrame, page_height: str = "height_pt") -> DataFrame:
    """Width, height and top edge in a y-down space for rows with rectangle columns."""
    return (
        rects.withColumn("width", F.col("right") - F.col("left"))
        .withColumn("height", F.col("top") - F.col("bottom"))
        .withColumn("screen_top", F.col(page_height) - F.col("top"))
        .withColumn("screen_bottom", F.col(page_height) - F.col("bottom"))
    )


def rect_bounds(pages: DataFrame) -> DataFrame:
    """Bounding box of every line of a page, lines told apart by their top."""
    return (
        pages.select("doc_id", "page_index", F.explode(line_boxes(F.col("char_rects"))).alias("b"))
        .select("doc_id", "page_index", "b.*")
    )


def page_geometry(page_info: DataFrame) -> DataFrame:
    """Orientation and the size shown after rotation; odd quarter turns swap the sides."""
    sideways = F.pmod("rotation_quarter_turns", F.lit(2)) == 1
    return page_info.select(
        "*",
        F.pmod("rotation_quarter_turns", F.lit(4)).alias("turns"),
        (F.col("width_pt") > F.col("height_pt")).alias("is_landscape"),
        F.when(sideways, F.col("height_pt")).otherwise(F.col("width_pt")).alias("shown_width_pt"),
        F.when(sideways, F.col("width_pt")).otherwise(F.col("height_pt")).alias("shown_height_pt"),
    )


def text_stats(pages: DataFrame) -> DataFrame:
    """Pages, pages with text, characters and whether the document needs OCR."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(has_text(F.col("full_text"))).alias("pages_with_text"),
        F.coalesce(F.sum(F.length("full_text")), F.lit(0)).alias("characters"),
    ).withColumn("needs_ocr", F.col("pages_with_text") == 0)
