"""Benchmark decontamination by template canonicalisation."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.plans.skew import dimension_join, measured_small

WINDOW = 5
CONTAINMENT = 0.8
CONSISTENCY = 0.8
# A window with fewer fixed words than this, and a passage with a smaller share of them, is evidence only where it is verbatim.
FIXED_WORDS = 2
FIXED_SHARE = 0.5
# Places of an item whose distance to the document changes by at most so many words are one passage.
RUN_GAP = 10
# Every digit of a text becomes part of NUMBER, so these three characters mean nothing else in a template.
NUMBER, NAME, UNIT = "0", "1", "2"
UNITS = ("kg|g|mg|lbs?|oz|km|m|cm|mm|mi|ft|yd|in|l|ml|cl|s|ms|min|h|hrs?|ha|hours?|minutes?|seconds?|days?|weeks?|months?|years?|"
         "decades?|centur(?:y|ies)|miles?|(?:kilo|centi|milli)?met(?:er|re)s?|(?:kilo|milli)?grams?|(?:centi|milli)?lit(?:er|re)s?|"
         "feet|foot|inch(?:es)?|yards?|pounds?|ounces?|tons?|tonnes?|gallons?|quarts?|pints?|cups?|acres?|hectares?|degrees?|"
         "mph|kph|kmh|k?w|kwh|watts?|volts?|dollars?|euros?|cents?|pence|percent|usd|eur|gbp|gb|mb|kb|tb")
NUMBERS = r"[0-9](?:[0-9.,:/]*[0-9])?"
INSIDE_NUMBER = r"(?<=[0-9])[.,:/]+(?=[0-9])"
# What may stand between a name and the word before it: blanks, opening brackets and quotes.
GAP = r"[\s\p{Z}\p{Ps}\p{Pi}\"']{1,4}"
NAMES = rf"\p{{Lu}}(?<=[\p{{Ll}}02,;]{GAP}\p{{Lu}})\p{{L}}*"
CASED = rf"{NAMES}|(?<!\p{{L}})\p{{Lu}}(?:\p{{Ll}}\p{{L}}*|(?!\p{{L}}))"
AFTER_NUMBER = rf"0([\s\p{{Z}}-]{{0,3}})(?i:{UNITS})(?![\p{{L}}0])"
# Words end at blanks, punctuation and symbols of Unicode.
WORDS = r"[^\s\x85\p{Z}\p{P}\p{S}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def template_words(text: Column, names: str | None = NAMES) -> Column:
    """Lower-cased words with numbers, names and units replaced by typed placeholders.

    A name is what ``names`` matches: a capitalised word after a lower-case letter, number, unit, comma or
    semicolon (``NAMES``), any capitalised word (``CASED``) or none; a unit stands after a number. No
    replacement touches a blank, so word and placeholder share a position.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), NUMBERS, NUMBER)
    text = F.regexp_replace(text, AFTER_NUMBER, f"{NUMBER}$1{UNIT}")
    if names:
        text = F.regexp_replace(text, names, NAME)
    return _words(F.lower(text))


def original_words(text: Column) -> Column:
    """The lower-cased words of the text at the positions of ``template_words``; a number is one word."""
    return _words(F.lower(F.regexp_replace(text, INSIDE_NUMBER, "")))


def is_slot(word: Column) -> Column:
    """Whether a template word begins with a placeholder: nothing else in a template sorts before "3"."""
    return word < "3"


def windows(df: DataFrame, key: str, width: int = WINDOW, names: str | None = CASED) -> DataFrame:
    """(key, pos, window, mask, words): hashed template windows of ``width`` words of each text.

    Bit k of ``mask`` tells whether word k is a slot. ``words`` holds the original words of windows with a
    slot, so slots can be compared without reading the text again. A window of slots with fewer than
    ``FIXED_WORDS`` other words says nothing as a template and would be the same everywhere: it is hashed by its
    original words. Texts shorter than ``width`` words have no window.
    """
    low, high = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
    hashed = df.select(key, "text", template_words(F.col("text"), names).alias("__words")).select(
        key,
        F.transform("__words", lambda w: F.when(is_slot(w), F.xxhash64(w).bitwiseOR(high))
                    .otherwise(F.xxhash64(w).bitwiseAND(low))).alias("__hashes"),
        F.when(F.exists("__words", is_slot), original_words(F.col("text"))).alias("__raw"),
    )
    # Positions are exploded before windows are hashed, so that compiled code does the rest. The outer form keeps the
    # optimiser from testing the size of the words below, which would canonicalise each text twice.
    places = F.when(F.size("__hashes") >= width, F.sequence(F.lit(1), F.size("__hashes") - (width - 1)))
    placed = hashed.select(key, "__hashes", "__raw", F.explode_outer(places).alias("pos"))
    parts = [F.element_at("__hashes", F.col("pos") + k) for k in range(width)]
    raw = [F.element_at("__raw", F.col("pos") + k) for k in range(width)]
    mask = reduce(Column.bitwiseOR, [F.shiftleft((part < 0).cast("int"), k) for k, part in enumerate(parts)])
    masked = placed.where("pos IS NOT NULL").select(key, "pos", "__hashes", "__raw", mask.alias("mask"))
    bare = F.bit_count("mask") > width - FIXED_WORDS
    return masked.select(
        key, "pos", F.when(bare, F.xxhash64(F.lit("verbatim"), *raw)).otherwise(F.xxhash64(*parts)).alias("window"), "mask",
        F.when(F.col("mask") > 0, F.slice("__raw", F.col("pos"), width)).alias("words"))


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item, item_pos, window, item_words) of every reading of an item that a document may show.

    A document's capitalised words are all read as names. Of an item the readings with all capitalised words, those inside
    a sentence or none as names count, with its first word as it stands or plain.
    """
    items = benchmark.select("item_id", "text")
    plain_first = items.withColumn("text", F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)")))
    readings = [windows(df, "item_id", width, names) for df in (items, plain_first) for names in (CASED, NAMES, None)]
    return (
        reduce(DataFrame.unionByName, readings)
        .select(F.struct("item_id").alias("item"), F.col("pos").alias("item_pos"), "window", F.col("words").alias("item_words"))
        .dropDuplicates(["item", "item_pos", "window"])
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, containment: float = CONTAINMENT,
    consistency: float = CONSISTENCY,
) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units.

    A pair (doc_id, item_id) is returned when one passage of the document holds at least ``containment`` of the
    item's template windows and replaces at least ``consistency`` of its slot values by one value each. A passage is an
    alignment of the item with the document, or a run of alignments that neighbour each other, as words were
    added or left out; each is judged by itself, so what stands elsewhere in the document neither helps nor
    hurts. Slots alone prove nothing: windows of slots only, and passages in which fewer than half of the words
    are fixed, count where they are verbatim. ``n_changed`` counts slot values that differ; the figures are those
    of the best passage. Blanks, line breaks, marks and the case of words do not matter; a capitalised word may stand
    for a name anywhere.

    Null or short texts and items (under ``width`` words) match nothing; rows that share an id are
    judged together; a null id is an id like others; empty tables give no rows; other columns are not read.
    """
    item = stored(item_windows(benchmark, width), "items")
    sizes = item.groupBy("item").agg(F.countDistinct("item_pos").alias("n_windows"))
    found = dimension_join(
        windows(docs.select(F.struct("doc_id").alias("doc"), "text"), "doc", width), item, ["window"],
        ["doc", "pos"], "inner",
    )
    shift = F.col("pos") - F.col("item_pos")
    placed = found.groupBy("doc", "item", shift.alias("shift")).agg(
        F.collect_set("item_pos").alias("hits"),
        F.array_distinct(F.flatten(F.collect_set(_slots()))).alias("slots"),
        F.sum(width - F.bit_count("mask")).alias("fixed"), F.count(F.lit(1)).alias("n"),
    )
    placed = stored(placed, "alignments")
    along = W.partitionBy("doc", "item").orderBy("shift")
    starts = F.coalesce(F.col("shift") - F.lag("shift").over(along) > RUN_GAP, F.lit(False)).cast("int")
    runs = (
        placed.withColumn("start", starts).withColumn("run", F.sum("start").over(along))
        .groupBy("doc", "item", "run")
        .agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
             F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
             F.sum("fixed").alias("fixed"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"))
        .where("places > 1")
    )
    passages = placed.drop("shift").unionByName(runs.drop("run", "places"))
    item_values = F.array_distinct(F.transform("slots", lambda s: s["item_value"]))
    one_value = F.filter(item_values, lambda v: F.size(F.filter("slots", lambda s: s["item_value"] == v)) == 1)
    judged = passages.select(
        "doc", "item", F.size("hits").alias("n_found"), F.size(item_values).alias("n_slots"), F.size(one_value).alias("n_kept"),
        F.size(F.filter("slots", lambda s: s["item_value"] != s["doc_value"])).alias("n_changed"),
        (F.col("fixed") / (F.col("n") * width)).alias("share"),
    )
    best = F.struct("n_found", (F.col("n_kept") - F.col("n_slots")).alias("lost"), (-F.col("n_changed")).alias("same"), "n_windows",
                    "n_slots", "n_kept", "n_changed")
    return (
        dimension_join(judged, sizes, ["item"], ["doc"], "inner")
        .where((F.col("n_found") >= F.lit(containment) * F.col("n_windows"))
               & (F.col("n_kept") >= F.lit(consistency) * F.col("n_slots"))
               & ((F.col("share") >= FIXED_SHARE) | (F.col("n_changed") == 0)))
        .groupBy("doc", "item").agg(F.max(best).alias("best"))
        .select("doc.doc_id", "item.item_id",
                *[F.col(f"best.{c}").cast("long").alias(c) for c in ("n_found", "n_windows", "n_slots", "n_kept", "n_changed")])
    )


def _slots() -> Column:
    """Pairs of item and document words at the slots of a window."""
    pairs = F.zip_with("item_words", "words", lambda a, b: F.struct(a.alias("item_value"), b.alias("doc_value")))
    at_slots = F.filter(pairs, lambda p, k: F.expr("mask").bitwiseAND(F.pow(F.lit(2), k).cast("int")) > 0)
    return F.coalesce(at_slots, F.array().cast("array<struct<item_value:string,doc_value:string>>"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item.

    Rows that share an id go together; a row without an id is judged by its own text.
    """
    own = F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    keyed = docs.withColumn("__key", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("row"), own))
    bad = contaminated(keyed.select(F.col("__key").alias("doc_id"), "text"), benchmark)
    bad = stored(bad.select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return keyed.join(F.broadcast(bad) if measured_small(bad) else bad, "__key", "left_anti").select(*docs.columns)
