"""Queries over page text, outlines, permissions and the operation log."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog.sql import COMMANDS, OPLOG, OUTLINE, PAGES, hits, with_
from shelfmark.functions.documents import decode_permissions, has_text, identity_hash, rebase_page
from shelfmark.functions.text import character_of, code_point
from shelfmark.operators import oplog, outline, page_index, pages, search
from shelfmark.session import shared_path
from shelfmark.sources import sample_tables as s
from shelfmark.sources.extract import extract_pages

QUERIES, SQL = {}, {}
WORD = "the"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# Search

@query("search_text", with_(PAGES, hits("The")) + 'SELECT doc_id, page_index, "offset", 3 AS length FROM hits')
def _(spark, d):
    return search.search_text(s.page_text(spark, d), "The")


_NUMBERED = """
numbered AS (SELECT doc_id, page_index, "offset", full_text, row_number() OVER w AS hit_number,
  count(*) OVER (PARTITION BY doc_id) AS hit_count, lag(page_index) OVER w AS prev_page, lag("offset") OVER w AS prev_offset,
  lead(page_index) OVER w AS next_page, lead("offset") OVER w AS next_offset
  FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, "offset"))"""


@query("hit_navigation", with_(PAGES, hits("license"), _NUMBERED) + "SELECT * EXCLUDE (full_text) FROM numbered")
def _(spark, d):
    return search.hit_navigation(s.page_text(spark, d), "License")


@query("search_report", with_(PAGES, hits(WORD), _NUMBERED) + """
SELECT * EXCLUDE (full_text), substr(full_text, greatest("offset" - 30, 0) + 1,
       "offset" - greatest("offset" - 30, 0) + 3 + 30) AS snippet FROM numbered""")
def _(spark, d):
    return search.search_report(s.page_text(spark, d), WORD)


@query("hit_snippets", with_(PAGES, hits("é")) + """
SELECT doc_id, page_index, "offset", substr(full_text, greatest("offset" - 12, 0) + 1,
       "offset" - greatest("offset" - 12, 0) + 1 + 12) AS snippet FROM hits""")
def _(spark, d):
    return search.hit_snippets(s.page_text(spark, d), "É", 12)


@query("hit_counts", with_(PAGES, hits(WORD)) + """
SELECT doc_id, sum(len(p) - 1)::BIGINT AS hits FROM parts GROUP BY 1""")
def _(spark, d):
    return search.hit_counts(s.page_text(spark, d), WORD)


@query("page_hit_counts", with_(PAGES, hits(WORD)) + "SELECT doc_id, page_index, (len(p) - 1)::BIGINT AS hits FROM parts")
def _(spark, d):
    return search.page_hit_counts(s.page_text(spark, d), WORD)


@query("first_page_with", with_(PAGES) + """
SELECT doc_id, coalesce(min(page_index) FILTER (WHERE contains(full_text, 'Apache')), -1)::INTEGER AS first_page
FROM page_text GROUP BY 1""")
def _(spark, d):
    return search.first_page_with(s.page_text(spark, d), "Apache")


_WORDS = "regexp_extract(text, '\\S+$')"


@query("search_many", with_(PAGES) + f"""
, queries AS (SELECT item_id AS query_id, lower({_WORDS}) AS q, length({_WORDS})::INTEGER AS n FROM benchmark),
parts AS (SELECT query_id, n, doc_id, page_index, string_split(lower(full_text), q) AS p
  FROM page_text JOIN queries ON contains(lower(full_text), q))
SELECT query_id, doc_id, page_index, n AS length,
       (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * n)::INTEGER AS "offset"
FROM (SELECT *, unnest(range(1, len(p))) AS i FROM parts)""")
def _(spark, d):
    queries = s.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.regexp_extract("text", r"\S+$", 0).alias("query"))
    return search.search_many(s.page_text(spark, d), queries)


_INDEXED = ["The", "license", "data", "that", "é"]


@query("search_index", " UNION ALL ".join(
    f"(SELECT '{w}' AS query, * FROM ({with_(PAGES, hits(w))} SELECT doc_id, page_index, \"offset\", {len(w)} AS length FROM hits))"
    for w in _INDEXED))
def _(spark, d):
    """The index is built in two parts, then answers every word; ``that`` overlaps itself and ``é`` is short."""
    table, target = s.page_text(spark, d), shared_path(spark, "page-index")
    for part in range(2):
        page_index.add_pages(table.where(F.pmod("doc_id", F.lit(2)) == part), target, str(part))
    index = page_index.read_index(spark, target)
    found = [page_index.search_index(index, table, w).select(F.lit(w).alias("query"), "*") for w in _INDEXED]
    return reduce(DataFrame.unionByName, found)


@query("hit_boxes", with_(PAGES, hits("license")) + """
SELECT doc_id, page_index, "offset", 0 AS line, "offset" * 7.0::DOUBLE AS "left", 800.0::DOUBLE AS top,
       ("offset" + 7) * 7.0::DOUBLE AS "right", 788.0::DOUBLE AS bottom FROM hits""")
def _(spark, d):
    return search.hit_boxes(s.page_rects(spark, d), "license")


# Page text

@query("explode_pages", with_(PAGES) + "SELECT doc_id, page_index, full_text FROM page_text")
def _(spark, d):
    docs = s.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("pages"))
    return pages.explode_pages(docs)


@query("pages_with_text", with_(PAGES) + "SELECT doc_id, page_index, full_text FROM page_text WHERE coalesce(full_text, '') <> ''")
def _(spark, d):
    return pages.pages_with_text(s.page_text(spark, d))


@query("text_stats", with_(PAGES) + """
SELECT doc_id, count(*) AS pages, count_if(full_text <> '')::BIGINT AS pages_with_text, sum(length(full_text))::BIGINT AS characters,
       count_if(full_text <> '') = 0 AS needs_ocr FROM page_text GROUP BY 1""")
def _(spark, d):
    return pages.text_stats(s.page_text(spark, d))


@query("check_alignment", with_(PAGES) + """
SELECT p.doc_id, p.page_index, coalesce(length(f.full_text), 0)::BIGINT AS rects, length(p.full_text)::BIGINT AS units
FROM page_text p LEFT JOIN page_text f ON f.doc_id = p.doc_id AND f.page_index = p.page_index - 1
WHERE coalesce(length(f.full_text), 0) <> length(p.full_text)""")
def _(spark, d):
    # Rectangles of the page before, so that most pages are misaligned.
    shifted = s.page_rects(spark, d).withColumn("page_index", F.col("page_index") + 1)
    return pages.check_alignment(s.page_text(spark, d), shifted)


@query("explode_chars", with_(PAGES) + """
SELECT doc_id, page_index, count(*) AS chars, max("index") AS last_index, sum("left")::DOUBLE AS lefts, max("right") AS last_right,
       min("character") AS low, max("character") AS high, count_if("character" = 'e')::BIGINT AS es
FROM (SELECT doc_id, page_index, (i - 1)::INTEGER AS "index", full_text[i] AS "character", (i - 1) * 7.0::DOUBLE AS "left",
             i * 7.0::DOUBLE AS "right"
      FROM (SELECT *, unnest(range(1, length(full_text) + 1)) AS i FROM page_text)) GROUP BY 1, 2""")
def _(spark, d):
    # One row per page keeps the compared result small; every character takes part. The smallest and largest are found as
    # numbers: strings would sort all characters before they are combined.
    point = code_point(F.col("character"))
    return pages.explode_chars(s.page_text(spark, d)).groupBy("doc_id", "page_index").agg(
        F.count(F.lit(1)).alias("chars"), F.max("index").alias("last_index"), F.sum("left").alias("lefts"),
        F.max("right").alias("last_right"), F.min(point).alias("low"), F.max(point).alias("high"),
        F.count_if(F.col("character") == "e").alias("es"),
    ).withColumns({c: character_of(F.col(c)) for c in ("low", "high")})


@query("grid_rects", with_(PAGES) + """
SELECT doc_id, page_index, length(full_text)::BIGINT AS rects, (length(full_text) * 7.0)::DOUBLE AS last_right FROM page_text""")
def _(spark, d):
    laid_out = pages.with_grid_rects(s.page_text(spark, d))
    return laid_out.select("doc_id", "page_index", F.size("char_rects").cast("bigint").alias("rects"),
                           F.try_element_at("char_rects", F.lit(-1))["right"].alias("last_right"))


@query("rect_bounds", with_(PAGES) + """
SELECT doc_id, page_index, 0.0::DOUBLE AS "left", 800.0::DOUBLE AS top, (length(full_text) * 7.0)::DOUBLE AS "right",
       788.0::DOUBLE AS bottom FROM page_text WHERE full_text <> ''""")
def _(spark, d):
    return pages.rect_bounds(s.page_rects(spark, d))


@query("rect_measures", with_(PAGES, hits("license")) + """
SELECT doc_id, page_index, "offset", 49.0::DOUBLE AS width, 12.0::DOUBLE AS height, 42.0::DOUBLE AS screen_top, 54.0::DOUBLE AS screen_bottom FROM hits""")
def _(spark, d):
    boxes = search.hit_boxes(s.page_rects(spark, d), "license").withColumn("height_pt", F.lit(842.0))
    return pages.rect_measures(boxes).select(
        "doc_id", "page_index", "offset", "width", "height", "screen_top", "screen_bottom")


_FLAGS = "flags AS (SELECT doc_id, CASE WHEN toxic = 1 THEN -44 - 16 WHEN quality = 1 THEN -44 END AS p FROM labels)"


def _permissions(spark, d):
    flags = F.when(F.col("toxic") == 1, F.lit(-60)).when(F.col("quality") == 1, F.lit(-44))
    return s.table(spark, d, "labels").select("doc_id", flags.alias("p_flags"))


@query("decode_permissions", with_(_FLAGS) + """
SELECT doc_id, (p & 4) <> 0 AS "print", (p & 8) <> 0 AS modify, (p & 16) <> 0 AS "copy", (p & 32) <> 0 AS annotate,
       (p & 1024) <> 0 AS assemble FROM flags""")
def _(spark, d):
    return _permissions(spark, d).select("doc_id", decode_permissions(F.col("p_flags")).alias("p")).select("doc_id", "p.*")


@query("copy_permitted", with_(PAGES) + """
SELECT doc_id, page_index, full_text FROM page_text WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(spark, d):
    return pages.copy_permitted(s.page_text(spark, d), _permissions(spark, d))


@query("select_range", with_(PAGES, hits("license")) + """
SELECT doc_id, page_index, "offset" AS start, "offset" + 20 AS stop, substr(full_text, "offset" + 1, 20) AS text,
       least(20, length(full_text) - "offset")::BIGINT AS rects, ("offset" * 7.0)::DOUBLE AS first_left
FROM hits WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(spark, d):
    text = s.page_text(spark, d)
    ranges = search.search_text(text, "license").select(
        "doc_id", "page_index", F.col("offset").alias("start"), (F.col("offset") + 20).alias("stop"))
    return pages.select_range(text, ranges, _permissions(spark, d)).select(
        "doc_id", "page_index", "start", "stop", "text", F.size("rects").cast("bigint").alias("rects"),
        F.get("rects", F.lit(0))["left"].alias("first_left"))


@query("page_geometry", """
SELECT p_partkey AS doc_id, p_size AS rotation_quarter_turns, p_size % 4 AS turns, false AS is_landscape,
  CASE WHEN p_size % 2 = 1 THEN 842.0::DOUBLE ELSE 595.0::DOUBLE END AS shown_width_pt,
  CASE WHEN p_size % 2 = 1 THEN 595.0::DOUBLE ELSE 842.0::DOUBLE END AS shown_height_pt FROM part""")
def _(spark, d):
    info = s.table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), F.lit(595.0).alias("width_pt"), F.lit(842.0).alias("height_pt"),
        F.col("p_size").cast("int").alias("rotation_quarter_turns"))
    return pages.page_geometry(info).drop("width_pt", "height_pt")


@query("rebase_page", with_(OUTLINE) + "SELECT node_id, page_index - 1 AS rebased FROM outline_nodes")
def _(spark, d):
    return s.outline_nodes(spark, d).select("node_id", rebase_page(F.col("page_index")).alias("rebased"))


@query("extract_pages", """
SELECT source || '/' || doc_id || '.pdf' AS path, (i - 1)::INTEGER AS page_index, parts[i] AS full_text, NULL::VARCHAR AS failure_code
FROM (SELECT source, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT d.*, string_split('%PDF-1.7' || chr(10) || replace(text, chr(10), chr(10) || '/Type /Page ' || chr(10)) || chr(10) || '%%EOF', chr(10)) AS parts
            FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1))
UNION ALL
SELECT source || '/' || doc_id || '.pdf', NULL, NULL, 'document_corrupt' FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(spark, d):
    from shelfmark.catalog.extractors import lines_of
    return extract_pages(s.files(spark, d), lines_of).select("path", "page_index", "full_text", "failure_code")


# Outline

_TREE = """
tree AS (
  SELECT doc_id, node_id, title, page_index, 0 AS depth, [ord] AS path FROM outline_nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT n.doc_id, n.node_id, n.title, n.page_index, t.depth + 1, list_append(t.path, n.ord)
  FROM outline_nodes n JOIN tree t ON n.doc_id = t.doc_id AND n.parent_id = t.node_id)"""


@query("flatten_outline", with_(OUTLINE, _TREE, recursive=True) + """
SELECT doc_id, node_id, title, page_index, depth, array_to_string(path, '.') AS path FROM tree""")
def _(spark, d):
    flat = outline.flatten_outline(s.outline_nodes(spark, d))
    return flat.withColumn("path", F.array_join(F.transform("path", lambda x: x["ord"].cast("string")), "."))


@query("preorder_rank", with_(OUTLINE, _TREE, recursive=True) + """
SELECT doc_id, node_id, title, page_index, depth, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS position FROM tree""")
def _(spark, d):
    return outline.preorder_rank(s.outline_nodes(spark, d))


# Operation log

@query("identity_hash", """
SELECT page_id, substr(sha256(url), 1, 16) AS file FROM pages""")
def _(spark, d):
    return s.table(spark, d, "pages").select("page_id", identity_hash(F.col("url")).alias("file"))


@query("redact_for_log", with_(OPLOG) + "SELECT op_id, phase, op, file_hash, bytes, result, ms, code, detail FROM oplog")
def _(spark, d):
    raw = s.oplog(spark, d).drop("file_hash")
    users = s.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("op_id"), F.col("user_id").cast("string").alias("path"), "props")
    return oplog.redact_for_log(raw.join(users, "op_id")).drop("ts")


_LINE = """concat_ws(' ', phase || ' op=' || op, 'result=' || result, 'ms=' || ms, 'code=' || code, 'detail=' || detail)"""


@query("compose_log_line", with_(OPLOG) + f"SELECT op_id, {_LINE} AS line FROM oplog")
def _(spark, d):
    return oplog.compose_log_line(s.oplog(spark, d)).select("op_id", "line")


@query("parse_log_line", with_(OPLOG) + f"SELECT {_LINE} AS line, phase, op, NULL::VARCHAR AS file_hash, NULL::BIGINT AS bytes, result, ms, code, detail FROM oplog")
def _(spark, d):
    return oplog.parse_log_line(oplog.compose_log_line(s.oplog(spark, d)).select("line"))


@query("operation_report", with_(OPLOG) + """
SELECT op, count(*) AS runs, count_if(result = 'success')::BIGINT AS successes, count_if(result = 'failure')::BIGINT AS failures,
       min(ms) AS min_ms, round(avg(ms), 6) AS avg_ms, round(quantile_cont(ms, 0.5), 6)::DOUBLE AS p50_ms,
       round(quantile_cont(ms, 0.95), 6)::DOUBLE AS p95_ms, max(ms) AS max_ms, sum(bytes)::BIGINT AS bytes FROM oplog GROUP BY 1""")
def _(spark, d):
    return oplog.operation_report(s.oplog(spark, d))


@query("failures_by_code", with_(OPLOG) + "SELECT op, code, count(*) AS failures FROM oplog WHERE result = 'failure' GROUP BY 1, 2")
def _(spark, d):
    return oplog.failures_by_code(s.oplog(spark, d))
