"""Literal search across documents: offsets, numbering, snippets and highlight boxes."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import (
    FOLDING_EXCEPTIONS,
    PLAIN_QUERY,
    let,
    line_boxes,
    literal_pattern,
    match_count,
    match_spans,
    match_starts,
    may_contain,
    occurrences,
    snippets,
)
from shelfmark.operators.terms import listed_keys, packs, rarest_pieces, text_keys
from shelfmark.session import cut_lineage

PAGES_PER_CHUNK = 1_024
ANY = "\0"


def _candidates(pages: DataFrame, query: str) -> DataFrame:
    """Pages the pattern has to look at; an empty query matches nowhere."""
    if query == "":
        return pages.where(F.lit(False))
    return pages.where(F.col("full_text").isNotNull() & may_contain(F.col("full_text"), query))


def page_hits(pages: DataFrame, query: str, around: int | None = None) -> DataFrame:
    """One row per page with at least one hit; ``hits`` is ordered by offset.

    With ``around`` each hit also carries its snippet.
    """
    text = F.col("full_text")
    starts = match_starts(text, query)
    if around is None:
        hits = F.transform(starts, lambda s: F.struct(s.alias("offset")))
    else:
        hits = let(starts, lambda xs: snippets(text, xs, F.lit(len(query)), around))
    # Exploding a filtered one-element array drops empty pages without running the
    # pattern a second time, as a pushed-down filter would.
    kept = F.explode(F.filter(F.array(hits), lambda h: F.size(h) > 0))
    return _candidates(pages, query).select("doc_id", "page_index", kept.alias("hits"))


def search_text(pages: DataFrame, query: str) -> DataFrame:
    """All case-insensitive occurrences, left to right and without overlap."""
    return _candidates(pages, query).select(
        "doc_id",
        "page_index",
        F.explode(match_starts(F.col("full_text"), query)).alias("offset"),
        F.lit(len(query)).alias("length"),
    )


def _position(page_index, offset):
    """Page and offset as one number that orders like the pair and has a fixed size."""
    return F.shiftleft(page_index.cast("bigint"), 32) + offset


def _page_and_offset(position, side: str):
    return (
        F.shiftright(position, 32).cast("int").alias(f"{side}_page"),
        position.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias(f"{side}_offset"),
    )


def number_hits(hits: DataFrame, keys=("doc_id",), pages_per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """Label each hit "i of n" within ``keys`` and point to its neighbours.

    Pages are numbered in chunks: a window over the few rows that summarize a document's
    chunks gives each chunk its start and outer neighbours, and a window inside the chunk
    does the rest. No task holds more than one chunk of a document, however long it is.

    The null checks are the ones the join would add to one of its sides; stating them up
    front keeps both uses of the exchange alike, so the search itself runs once.
    """
    keys = list(keys)
    chunk = [*keys, "chunk"]
    placed = (
        hits.withColumn("chunk", F.floor(F.col("page_index") / F.lit(pages_per_chunk)).cast("int"))
        .where(reduce(and_, [F.col(c).isNotNull() for c in chunk]))
        .repartition(*chunk)
    )
    first = _position(F.col("page_index"), F.get("hits", F.lit(0))["offset"])
    last = _position(F.col("page_index"), F.element_at("hits", -1)["offset"])

    along = W.partitionBy(*keys).orderBy("chunk")
    summary = placed.groupBy(*chunk).agg(
        F.sum(F.size("hits")).alias("n"), F.min(first).alias("first"), F.max(last).alias("last")
    )
    frame = summary.select(
        *chunk,
        F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("chunk_base"),
        F.sum("n").over(W.partitionBy(*keys)).alias("hit_count"),
        F.lag("last").over(along).alias("chunk_prev"),
        F.lead("first").over(along).alias("chunk_next"),
    )
    inside = W.partitionBy(*chunk).orderBy("page_index")
    before = F.coalesce(F.sum(F.size("hits")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pages = placed.join(frame, chunk).select(
        *keys, "page_index", "hits", "hit_count",
        (F.col("chunk_base") + before).alias("base"),
        F.coalesce(F.lag(last).over(inside), F.col("chunk_prev")).alias("page_prev"),
        F.coalesce(F.lead(first).over(inside), F.col("chunk_next")).alias("page_next"),
    )

    def labelled(hit, i):
        def neighbour(at, outside):
            return F.coalesce(_position(F.col("page_index"), F.get(F.col("hits"), at)["offset"]), F.col(outside))

        return F.struct(
            hit.alias("hit"),
            (F.col("base") + i + 1).cast("bigint").alias("hit_number"),
            neighbour(i - 1, "page_prev").alias("prev"),
            neighbour(i + 1, "page_next").alias("next"),
        )

    exploded = pages.select(*keys, "page_index", "hit_count", F.explode(F.transform("hits", labelled)).alias("h"))
    return exploded.select(
        *keys, "page_index", "h.hit.*", "h.hit_number", "hit_count",
        *[part for side in ("prev", "next") for part in _page_and_offset(F.col("h")[side], side)],
    )


def hit_navigation(pages: DataFrame, query: str) -> DataFrame:
    return number_hits(page_hits(pages, query))


def search_report(pages: DataFrame, query: str, around: int = 30) -> DataFrame:
    """Cross-document hit list: numbered hits with neighbours and snippets."""
    return number_hits(page_hits(pages, query, around))


def hit_snippets(pages: DataFrame, query: str, around: int = 30) -> DataFrame:
    return (
        page_hits(pages, query, around)
        .select("doc_id", "page_index", F.explode("hits").alias("h"))
        .select("doc_id", "page_index", "h.*")
    )


def hit_counts(pages: DataFrame, query: str) -> DataFrame:
    """Hits per document, zero included."""
    counted = pages.select("doc_id", match_count(F.col("full_text"), query).alias("n"))
    return counted.groupBy("doc_id").agg(F.sum("n").alias("hits"))


def page_hit_counts(pages: DataFrame, query: str) -> DataFrame:
    return pages.select("doc_id", "page_index", match_count(F.col("full_text"), query).alias("hits"))


def first_page_with(pages: DataFrame, token: str) -> DataFrame:
    """Lowest page holding ``token`` exactly as written; -1 when no page does."""
    found = F.when(F.contains("full_text", F.lit(token)), F.col("page_index"))
    return pages.groupBy("doc_id").agg(F.coalesce(F.min(found), F.lit(-1)).alias("first_page"))


def _folded(text):
    """Lower-cased text in which every plain query that a case-insensitive pattern matches can be found literally.

    Three characters beyond Latin-1 match plain letters although lower-casing does not make them so; only texts that hold
    one of them are translated, as that goes character by character.
    """
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in FOLDING_EXCEPTIONS[1:-1]])
    return F.lower(F.when(odd, F.translate(text, FOLDING_EXCEPTIONS[1:-1], "iis")).otherwise(text))


def keyed_queries(queries: DataFrame) -> DataFrame:
    """Give every non-empty query the key it is looked up by.

    A plain query is keyed by the three-character piece that the fewest queries share, or by itself when it is
    shorter. Any other query has the same key ``ANY``, which every page shows.
    """
    plain = F.col("query").rlike(PLAIN_QUERY)
    listed = queries.where(F.length("query") > 0).select(
        "query_id", "query", F.lower("query").alias("low"), literal_pattern(F.col("query")).alias("pattern"), plain.alias("plain"))
    keys = rarest_pieces(listed.where(F.col("plain")), "low").withColumn("plain", F.lit(True))
    return listed.join(keys, ["low", "plain"], "left").select(
        "query_id", "query", "low", "pattern", "plain", F.coalesce("piece", F.lit(ANY)).alias("key"))


def search_many(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """``search_text`` for every row of ``queries`` (``query_id``, ``query``) in one pass.

    Each page is looked through once for the pieces that are keys of queries, and those it holds meet the broadcast
    queries they may contain, so the work per page hardly depends on how many queries there are, and no text
    is exchanged. A list that is too large to broadcast costs one pass over the text for each part of measured size.
    """
    keyed = cut_lineage(keyed_queries(queries))
    wanted = keyed.select("key", "query_id", "low", "pattern", "plain", F.length("query").alias("length"))
    text = F.col("full_text")
    folded = pages.where(text.isNotNull()).select("doc_id", "page_index", "full_text", _folded(text).alias("folded"))
    out = None
    for pack in packs(wanted, ["query_id", "key"]):
        keys = text_keys(F.col("folded"), listed_keys(pack.where(F.col("plain")), "key"))
        if not pack.where(~F.col("plain")).isEmpty():
            keys = F.concat(keys, F.array(F.lit(ANY)))
        cut = folded.withColumn("keys", keys).select("doc_id", "page_index", "full_text", "folded", F.explode_outer("keys").alias("key"))
        checked = cut.join(F.broadcast(pack), "key").where(~F.col("plain") | F.contains("folded", "low"))
        hits = occurrences(F.split(text, F.col("pattern"), -1), F.col("length"))
        rows = checked.select("query_id", "doc_id", "page_index", F.explode(hits).alias("offset"), "length")
        out = rows if out is None else out.unionByName(rows)
    return out


def hit_boxes(pages: DataFrame, query: str) -> DataFrame:
    """Bounding boxes of each hit, one per line it covers.

    Boxes are built before the hits are exploded, so a page's rectangles are never
    copied once per hit.
    """
    rects = F.col("char_rects")

    def boxed(m):
        cut = F.slice(rects, m["unit_offset"] + 1, m["unit_length"])
        return F.struct(m["offset"].alias("offset"), let(cut, line_boxes).alias("boxes"))

    found = F.transform(match_spans(F.col("full_text"), query), boxed)
    return (
        _candidates(pages, query)
        .select("doc_id", "page_index", F.explode(found).alias("h"))
        .select("doc_id", "page_index", "h.offset", F.posexplode_outer("h.boxes").alias("line", "box"))
        .select("doc_id", "page_index", "offset", "line", "box.*")
    )
