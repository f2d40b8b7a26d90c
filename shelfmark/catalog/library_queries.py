"""Queries over the library, its collections, references and command log."""

from pyspark.sql import functions as F

from shelfmark.catalog.sql import COLLECTIONS, COMMANDS, FILES, FOLD, LIBRARY, with_
from shelfmark.functions.documents import tile_line
from shelfmark.functions.refs import decode_ref, encode_ref, is_managed, ref_kind
from shelfmark.operators import audit, commands, intake, library, references
from shelfmark.plans.ranking import with_row_positions
from shelfmark.schemas import DENY_TERMS, FAILURE_MESSAGES
from shelfmark.session import shared_path
from shelfmark.sources import files as file_io
from shelfmark.sources import sample_tables as s
from shelfmark.sources import snapshots

QUERIES, SQL = {}, {}

FLAT = ["owner_id", "doc_id", "display_name", "size_bytes", "added_at", "last_opened_at",
        "is_favorite", "page_count", "collection_id"]
COLS = ", ".join(FLAT)
NOW = "2024-06-01 00:00:00"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def flat(df):
    return df.select(*FLAT)


# Filters, sorts and top-k

@query("all_documents", with_(LIBRARY) + f"SELECT {COLS} FROM library")
def _(spark, d):
    return flat(library.all_documents(s.library(spark, d)))


@query("filter_by_name", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE contains(lower(display_name), '/en-1')")
def _(spark, d):
    return flat(library.filter_by_name(s.library(spark, d), "  /EN-1 "))


@query("favorites", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE is_favorite")
def _(spark, d):
    return flat(library.favorites(s.library(spark, d)))


@query("opened_only", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE last_opened_at IS NOT NULL")
def _(spark, d):
    return flat(library.opened_only(s.library(spark, d)))


@query("documents_in_root", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE collection_id IS NULL AND owner_id = 'src1'")
def _(spark, d):
    return flat(library.documents_in(s.library(spark, d), None, "src1"))


@query("documents_in_collection", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE collection_id = 3 AND owner_id = 'src0'")
def _(spark, d):
    return flat(library.documents_in(s.library(spark, d), 3, "src0"))


@query("in_selected_collection", with_(LIBRARY) + f"""
SELECT {COLS} FROM library WHERE owner_id = 'src0' AND collection_id = 1""")
def _(spark, d):
    return flat(library.in_selected_collection(s.library(spark, d), 1, "src0"))


@query("in_all_collections", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE owner_id = 'src2'")
def _(spark, d):
    return flat(library.in_selected_collection(s.library(spark, d), owner_id="src2"))


@query("get_document", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE doc_id = 7")
def _(spark, d):
    return flat(library.get_document(s.library(spark, d), 7))


def _sort(name, field, ascending, key):
    # The position column makes the order itself part of the compared result.
    @query(name, with_(LIBRARY) + f"""
SELECT {COLS}, row_number() OVER (ORDER BY {key}, doc_id) - 1 AS position FROM library""")
    def _(spark, d):
        # Positions come from the order the operator leaves its rows in.
        ordered = library.sort_documents(flat(s.library(spark, d)), field, ascending)
        return with_row_positions(ordered, "position")


_sort("sort_by_name", "name", True, "lower(display_name) ASC")
_sort("sort_by_date_added", "date_added", False, "added_at DESC")
_sort("sort_by_date_opened", "date_opened", False, "last_opened_at DESC NULLS LAST")
_sort("sort_by_size", "size", True, "size_bytes ASC")


@query("recents", with_(LIBRARY) + f"""
SELECT {COLS} FROM library WHERE last_opened_at IS NOT NULL AND owner_id = 'src0'
ORDER BY last_opened_at DESC, doc_id LIMIT 20""")
def _(spark, d):
    return flat(library.recents(s.library(spark, d), owner_id="src0"))


@query("recents_per_owner", with_(LIBRARY) + f"""
SELECT {COLS}, recent_rank::INTEGER AS recent_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY last_opened_at DESC, doc_id) AS recent_rank
  FROM library WHERE last_opened_at IS NOT NULL) WHERE recent_rank <= 5""")
def _(spark, d):
    return library.recents_per_owner(s.library(spark, d), 5).select(*FLAT, "recent_rank")


@query("visible_documents", with_(LIBRARY) + f"""
SELECT {COLS} FROM library WHERE owner_id = 'src1' AND collection_id IS NULL AND contains(lower(display_name), 'en-1')
ORDER BY lower(display_name), doc_id""")
def _(spark, d):
    return flat(library.visible_documents(s.library(spark, d), "EN-1", "name", True, None, "src1"))


@query("attach_collection", with_(LIBRARY, COLLECTIONS) + """
SELECT l.doc_id, l.display_name, l.collection_id, c.name AS collection_name
FROM library l LEFT JOIN collections c USING (owner_id, collection_id)""")
def _(spark, d):
    return library.attach_collection(s.library(spark, d), s.collections(spark, d)).select(
        "doc_id", "display_name", "collection_id", "collection_name")


@query("selected_documents", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return flat(library.selected_documents(s.library(spark, d), s.table(spark, d, "labels")))


@query("unselected_documents", with_(LIBRARY) + f"SELECT {COLS} FROM library WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return flat(library.selected_documents(s.library(spark, d), s.table(spark, d, "labels"), keep=False))


@query("merge_sources", with_(LIBRARY) + f"SELECT {COLS} FROM library")
def _(spark, d):
    lib = s.library(spark, d)
    managed = is_managed(F.col("ref"))
    return flat(library.merge_sources(lib.where(managed), lib.where(~managed).drop("storage_key", "content_hash")))


# Rows in and out

@query("tile_line", with_(LIBRARY) + """
SELECT doc_id, kind, concat_ws(' · ', floor(size_bytes / 1024.0 + 0.5)::BIGINT || ' KB', page_count || ' pages',
       CASE WHEN kind = 'managed' THEN 'Imported copy' END) AS line FROM library""")
def _(spark, d):
    return s.library(spark, d).select("doc_id", ref_kind(F.col("ref")).alias("kind"), tile_line(
        F.col("size_bytes"), F.col("page_count"), is_managed(F.col("ref"))).alias("line"))


@query("patch_fields", with_(LIBRARY) + """
SELECT l.doc_id, coalesce(p.display_name, l.display_name) AS display_name,
       coalesce(p.is_favorite, l.is_favorite) AS is_favorite
FROM library l LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged-' || doc_id END AS display_name,
  CASE WHEN quality = 0 THEN true END AS is_favorite FROM labels) p USING (doc_id)""")
def _(spark, d):
    patches = s.table(spark, d, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.concat(F.lit("flagged-"), F.col("doc_id").cast("string"))).alias("display_name"),
        F.when(F.col("quality") == 0, F.lit(True)).alias("is_favorite"))
    out = library.patch_fields(s.library(spark, d), patches, ["display_name", "is_favorite"])
    return out.select("doc_id", "display_name", "is_favorite")


@query("insert_documents", with_(LIBRARY) + f"""
SELECT {COLS} FROM library
UNION ALL
SELECT 'crawl', (SELECT max(doc_id) FROM library) + row_number() OVER (ORDER BY url), url, strlen(html)::BIGINT,
       TIMESTAMP '{NOW}', NULL, false, NULL, NULL FROM pages""")
def _(spark, d):
    batch = s.table(spark, d, "pages").select(
        F.lit("crawl").alias("owner_id"), F.col("url").alias("display_name"),
        F.octet_length("html").cast("bigint").alias("size_bytes"))
    return flat(library.insert_documents(s.library(spark, d), batch, NOW))


@query("register_external", with_(LIBRARY) + f"""
SELECT doc_id, kind, display_name, size_bytes, NULL AS path FROM library
UNION ALL
SELECT (SELECT max(doc_id) FROM library) + row_number() OVER (ORDER BY url), 'external',
       split_part(url, '/', -1), strlen(html)::BIGINT, url FROM pages""")
def _(spark, d):
    found = s.table(spark, d, "pages").select(
        F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("length"))
    out = library.register_external(s.library(spark, d), found, F.lit("crawl"), NOW)
    return out.select("doc_id", "ref.kind", "display_name", "size_bytes", "ref.handle.path")


@query("upgrade_schema", with_(LIBRARY) + f"SELECT {COLS.replace('collection_id', 'NULL::BIGINT AS collection_id')} FROM library")
def _(spark, d):
    return flat(library.upgrade_schema(s.library(spark, d).drop("collection_id"))[0])


@query("duplicate_documents", with_(LIBRARY) + f"""
SELECT doc_id, display_name, size_bytes, content_hash AS storage_key, is_favorite, collection_id FROM library
UNION ALL
SELECT (SELECT max(doc_id) FROM library) + row_number() OVER (ORDER BY event_id), l.display_name || ' copy',
       l.size_bytes, sha256(l.content_hash || '|' || event_id), false, NULL
FROM events e JOIN library l ON l.doc_id = e.user_id WHERE e.event_type = 'purchase'""")
def _(spark, d):
    asked = s.table(spark, d, "events").where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"))
    out = library.duplicate_documents(s.library(spark, d), asked, NOW)
    return out.select("doc_id", "display_name", "size_bytes", "storage_key", "is_favorite", "collection_id")


@query("plan_copies", with_(LIBRARY) + """
SELECT e.event_id AS seq, e.user_id AS doc_id, CASE WHEN l.kind = 'managed' THEN l.content_hash END AS source_key,
       CASE WHEN l.kind = 'managed' THEN sha256(l.content_hash || '|' || e.event_id) END AS new_key,
       CASE WHEN l.doc_id IS NULL OR l.kind = 'external' THEN 'document_moved' END AS failure_code,
       CASE WHEN l.doc_id IS NULL THEN 'no such document' WHEN l.kind = 'external' THEN 'source content is not resolved' END AS failure_detail
FROM events e LEFT JOIN library l ON l.doc_id = e.user_id WHERE e.event_type = 'purchase'""")
def _(spark, d):
    asked = s.table(spark, d, "events").where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"))
    # Files left in place have no hash of their own until they are read.
    lib = s.library(spark, d).withColumn("content_hash", F.when(is_managed(F.col("ref")), F.col("content_hash")))
    return library.plan_copies(lib, asked).select("seq", "doc_id", "source_key", "new_key", "failure_code", "failure_detail")


@query("import_files", with_(LIBRARY, FILES) + f"""
, accepted AS (SELECT split_part(path, '/', -1) AS display_name, sha256(body) AS content_hash, strlen(body)::BIGINT AS size_bytes, path
  FROM files WHERE good),
firsts AS (SELECT arg_min(display_name, path) AS display_name, content_hash, any_value(size_bytes) AS size_bytes FROM accepted GROUP BY 2)
SELECT owner_id, doc_id, display_name, size_bytes, content_hash, collection_id FROM library
UNION ALL
SELECT 'import', (SELECT max(doc_id) FROM library) + row_number() OVER (ORDER BY display_name), display_name, size_bytes, content_hash, NULL
FROM firsts""")
def _(spark, d):
    out = library.import_files(s.library(spark, d), s.files(spark, d), "import", NOW)
    return out.select("owner_id", "doc_id", "display_name", "size_bytes", "content_hash", "collection_id")


@query("publish_snapshot", with_(LIBRARY) + f"SELECT {COLS} FROM library")
def _(spark, d):
    target = shared_path(spark, "library")
    lib = s.library(spark, d)
    snapshots.publish_audited(spark, lambda: lib, target, lambda w: w.count() == s.table(spark, d, "documents").count())
    return flat(snapshots.read_published(spark, target))


@query("export_subset", with_(LIBRARY) + """
SELECT l.doc_id, l.display_name, l.size_bytes, sha256(d.text) AS written_hash
FROM library l JOIN documents d USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(spark, d):
    target = shared_path(spark, "export")
    contents = s.table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("content")).select(
        F.sha2("content", 256).alias("storage_key"), "content").groupBy("storage_key").agg(F.first("content").alias("content"))
    file_io.export_subset(s.library(spark, d), s.table(spark, d, "labels").where(F.col("quality") == 1), contents, target)
    return snapshots.read_published(spark, target).select(
        "doc_id", "display_name", "size_bytes", F.sha2("content", 256).alias("written_hash"))


# Intake and duplicates

@query("scan_files", """
WITH lines AS (SELECT doc_id // 50 AS shelf, coalesce(text, '') || chr(10) AS line, doc_id FROM documents)
SELECT shelf, sha256(string_agg(line, '' ORDER BY doc_id)) AS content_hash, sum(strlen(line))::BIGINT AS size_bytes,
       NULL::VARCHAR AS failure_code FROM lines GROUP BY 1""")
def _(spark, d):
    # Fifty documents make a text file; the files are then scanned as bytes.
    folder = shared_path(spark, "files")
    shelf = F.floor(F.col("doc_id") / 50).cast("bigint")
    s.documents(spark, d).select(shelf.alias("shelf"), "doc_id", F.coalesce("text", F.lit("")).alias("value")).repartition(
        "shelf").sortWithinPartitions("shelf", "doc_id").select("shelf", "value").write.partitionBy("shelf").text(folder)
    found = intake.content_address(file_io.scan_files(spark, folder, names="*.txt"))
    return found.select(
        F.regexp_extract("path", r"shelf=(\d+)", 1).cast("bigint").alias("shelf"), "content_hash", "size_bytes", "failure_code")


@query("classify_intake", with_(FILES) + """
SELECT path, CASE WHEN NOT starts_with(body, '%PDF') THEN 'document_corrupt' END AS failure_code,
       CASE WHEN NOT starts_with(body, '%PDF') THEN 'missing %PDF header' END AS failure_detail FROM files
UNION ALL
SELECT DISTINCT url, 'document_moved', 'source file does not exist' FROM pages""")
def _(spark, d):
    f = s.files(spark, d)
    asked = f.select("path").unionByName(s.table(spark, d, "pages").select(F.col("url").alias("path")))
    return intake.classify_intake(f, asked).select("path", "failure_code", "failure_detail")


@query("content_address", with_(FILES) + """
SELECT path, sha256(body) AS content_hash, substr(sha256(body), 1, 2) || '/' || sha256(body) || '.pdf' AS relative_path,
       strlen(body)::BIGINT AS size_bytes FROM files""")
def _(spark, d):
    return intake.content_address(s.files(spark, d))


@query("triage_bytes", with_(FILES) + r"""
SELECT path, len(regexp_extract_all(body, '/Type\s*/Page[^s]'))::BIGINT AS page_objects,
       contains(body, '%%EOF') AS has_eof, contains(body, '/Encrypt') AS has_encrypt,
       contains(body, '/JavaScript') AS has_javascript FROM files""")
def _(spark, d):
    return intake.triage_bytes(s.files(spark, d))


@query("duplicate_groups", with_(LIBRARY) + """
SELECT owner_id, content_hash, count(*) AS copies, min(doc_id) AS keeper FROM library
GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    return intake.duplicate_groups(s.library(spark, d))


@query("duplicate_groups_global", with_(LIBRARY) + """
SELECT content_hash, count(*) AS copies, min(doc_id) AS keeper FROM library GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return intake.duplicate_groups(s.library(spark, d), intake.GLOBAL)


@query("duplicate_members", with_(LIBRARY) + """
SELECT * FROM (SELECT owner_id, content_hash, doc_id, count(*) OVER w AS copies, min(doc_id) OVER w AS keeper,
  doc_id = min(doc_id) OVER w AS is_keeper FROM library WINDOW w AS (PARTITION BY owner_id, content_hash)) WHERE copies > 1""")
def _(spark, d):
    return intake.duplicate_members(s.library(spark, d))


@query("distinct_content", with_(LIBRARY) + f"""
SELECT {COLS} FROM library WHERE doc_id IN (SELECT min(doc_id) FROM library GROUP BY owner_id, content_hash)""")
def _(spark, d):
    return flat(intake.distinct_content(s.library(spark, d)))


@query("storage_footprint", with_(LIBRARY) + """
SELECT owner_id, sum(logical)::BIGINT AS logical_bytes, sum(stored)::BIGINT AS stored_bytes,
       (sum(logical) - sum(stored))::BIGINT AS saved_bytes
FROM (SELECT owner_id, content_hash, sum(size_bytes) AS logical, max(size_bytes) AS stored
      FROM library WHERE kind = 'managed' GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    return intake.storage_footprint(s.library(spark, d))


@query("collectable_files", with_(LIBRARY) + """
SELECT DISTINCT content_hash AS storage_key, size_bytes FROM library WHERE content_hash NOT IN
  (SELECT content_hash FROM library WHERE kind = 'managed' AND doc_id IN (SELECT doc_id FROM labels))""")
def _(spark, d):
    lib = s.library(spark, d)
    stored = lib.select("storage_key", "size_bytes").distinct()
    return intake.collectable_files(stored, library.selected_documents(lib, s.table(spark, d, "labels")))


# References

@query("encode_ref", with_(LIBRARY) + """
SELECT doc_id, CASE WHEN kind = 'managed'
  THEN '{"kind":"managed","relativePath":"' || substr(content_hash, 1, 2) || '/' || content_hash || '.pdf","contentHash":"' || content_hash || '"}'
  ELSE '{"kind":"external","displayName":"' || display_name || '","handle":{"type":"contentUri","uri":"content://' || owner_id || '/' || doc_id || '"}}'
  END AS payload FROM library""")
def _(spark, d):
    return s.library(spark, d).select("doc_id", encode_ref(F.col("ref")).alias("payload"))


@query("decode_ref", with_(LIBRARY) + """
SELECT doc_id, kind, CASE WHEN kind = 'managed' THEN substr(content_hash, 1, 2) || '/' || content_hash || '.pdf' END AS relative_path,
  CASE WHEN kind = 'external' THEN 'content://' || owner_id || '/' || doc_id END AS uri, NULL::VARCHAR AS error FROM library
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'payload is not an object' FROM documents""")
def _(spark, d):
    good = s.library(spark, d).select("doc_id", encode_ref(F.col("ref")).alias("payload"))
    bad = s.table(spark, d, "documents").select("doc_id", F.col("text").alias("payload"))
    out = good.unionByName(bad).select("doc_id", decode_ref(F.col("payload")).alias("r"))
    return out.select("doc_id", "r.ref.kind", "r.ref.relative_path", "r.ref.handle.uri", "r.error")


_GRANTS = """
grants AS (SELECT 'content://' || d.source || '/' || d.doc_id AS handle,
  CASE WHEN l.toxic = 1 THEN 'revoked' WHEN l.quality = 0 THEN 'stale' ELSE 'ok' END AS status
  FROM documents d JOIN labels l USING (doc_id)),
present AS (SELECT DISTINCT sha256(d.text) AS content_hash FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
resolved AS (
  SELECT l.doc_id,
    CASE WHEN l.kind = 'managed' THEN CASE WHEN p.content_hash IS NULL THEN 'document_moved' END
         WHEN g.status = 'ok' THEN NULL WHEN g.status IN ('stale', 'revoked') THEN 'permission_revoked'
         ELSE 'document_moved' END AS failure_code,
    CASE WHEN l.kind = 'managed' THEN CASE WHEN p.content_hash IS NULL THEN 'managed copy is missing' END
         WHEN coalesce(g.status, 'missing') <> 'ok' THEN coalesce(g.status, 'missing') END AS failure_detail,
    CASE WHEN l.kind = 'managed' THEN substr(l.content_hash, 1, 2) || '/' || l.content_hash || '.pdf'
         ELSE 'content://' || l.owner_id || '/' || l.doc_id END AS path
  FROM library l LEFT JOIN present p USING (content_hash)
  LEFT JOIN grants g ON l.kind = 'external' AND g.handle = 'content://' || l.owner_id || '/' || l.doc_id)"""


def _resolved(spark, d):
    docs, labels = s.table(spark, d, "documents"), s.table(spark, d, "labels")
    from shelfmark.functions.documents import address_of
    present = docs.join(labels.where(F.col("quality") == 1), "doc_id").select(address_of(F.sha2("text", 256)).alias("path"))
    grants = docs.join(labels, "doc_id").select(
        F.concat(F.lit("content://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("handle"),
        F.when(F.col("toxic") == 1, "revoked").when(F.col("quality") == 0, "stale").otherwise("ok").alias("status"))
    return references.resolve_refs(s.library(spark, d), present, grants)


@query("resolve_refs", with_(LIBRARY, _GRANTS) + """
SELECT doc_id, failure_code, failure_detail, CASE WHEN failure_code IS NULL THEN path END AS readable_path FROM resolved""")
def _(spark, d):
    return _resolved(spark, d).select("doc_id", "failure_code", "failure_detail", "readable_path")


_MESSAGES = "messages(code, title, body) AS (VALUES " + ", ".join(
    f"('{c}', '{t}', '{b}')" for c, t, b in FAILURE_MESSAGES) + ")"


@query("attach_failure_message", with_(LIBRARY, _GRANTS, _MESSAGES) + """
SELECT r.doc_id, r.failure_code, m.title, m.body FROM resolved r LEFT JOIN messages m ON m.code = r.failure_code""")
def _(spark, d):
    return audit.attach_failure_message(_resolved(spark, d)).select("doc_id", "failure_code", "title", "body")


# Audit

_DENY = "deny_terms(term) AS (VALUES " + ", ".join(f"('{t}')" for t in DENY_TERMS) + ")"


def _items(spark, d):
    return s.table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")


@query("deny_list_hits", with_(_DENY) + """
SELECT d.doc_id AS item, t.term FROM documents d JOIN deny_terms t ON contains(lower(d.text), lower(t.term))""")
def _(spark, d):
    return audit.deny_list_hits(_items(spark, d))


@query("deny_list_verdict", with_(_DENY) + """
SELECT d.doc_id AS item, count(t.term) AS denied_terms, count(t.term) = 0 AS passed
FROM documents d LEFT JOIN deny_terms t ON contains(lower(d.text), lower(t.term)) GROUP BY 1""")
def _(spark, d):
    return audit.deny_list_verdict(_items(spark, d))


@query("undocumented", """
SELECT DISTINCT source AS name FROM documents WHERE source NOT IN
  (SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)""")
def _(spark, d):
    docs = s.table(spark, d, "documents")
    names = docs.select(F.col("source").alias("name")).distinct()
    toxic = s.table(spark, d, "labels").where(F.col("toxic") == 1)
    return audit.undocumented(names, docs.join(toxic, "doc_id").select(F.col("source").alias("name")))


@query("unmentioned", """
WITH words AS (SELECT DISTINCT regexp_extract(text, '^\\S+') AS name FROM benchmark)
SELECT name FROM words w WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, w.name))""")
def _(spark, d):
    names = s.table(spark, d, "benchmark").select(F.regexp_extract("text", r"^\S+", 0).alias("name"))
    return audit.unmentioned(names, s.table(spark, d, "documents").select("text"))


@query("collection_counts", with_(LIBRARY, COLLECTIONS) + """
SELECT coalesce(h.owner_id, c.owner_id) AS owner_id, coalesce(h.collection_id, c.collection_id) AS collection_id, c.name,
       coalesce(documents, 0)::BIGINT AS documents, coalesce(bytes, 0)::BIGINT AS bytes
FROM (SELECT owner_id, collection_id, count(*) AS documents, sum(size_bytes) AS bytes FROM library GROUP BY 1, 2) h
FULL JOIN collections c ON h.owner_id = c.owner_id AND h.collection_id = c.collection_id""")
def _(spark, d):
    return audit.collection_counts(s.library(spark, d), s.collections(spark, d))


@query("assert_unique", """
SELECT count(*)::BIGINT AS total, count(DISTINCT url)::BIGINT AS distinct_keys, count_if(coalesce(url, '') = '')::BIGINT AS blank_keys,
       count(*) = count(DISTINCT url) AND count_if(coalesce(url, '') = '') = 0 AS is_unique FROM pages""")
def _(spark, d):
    return audit.assert_unique(s.table(spark, d, "pages"), "url")


# Commands

def _log(spark, d):
    return s.library(spark, d), s.collections(spark, d), s.commands(spark, d)


@query("apply_commands", with_(LIBRARY, COLLECTIONS, COMMANDS, FOLD) + """
SELECT l.owner_id, l.doc_id, coalesce(r.name, l.display_name) AS display_name, l.size_bytes, l.added_at,
       coalesce(o.at, l.last_opened_at) AS last_opened_at,
       coalesce(s.val, l.is_favorite) <> (coalesce(t.n, 0) % 2 = 1) AS is_favorite, l.page_count,
       CASE WHEN m.doc_id IS NOT NULL THEN m.moved.v WHEN x.owner_id IS NULL THEN l.collection_id END AS collection_id
FROM library l LEFT JOIN renamed r USING (doc_id) LEFT JOIN opened o USING (doc_id) LEFT JOIN sets s USING (doc_id)
LEFT JOIN toggles t USING (doc_id) LEFT JOIN moves m USING (doc_id)
LEFT JOIN cleared x ON x.owner_id = l.owner_id AND x.collection_id = l.collection_id
WHERE l.doc_id NOT IN (SELECT doc_id FROM commands WHERE op = 'delete')""")
def _(spark, d):
    return flat(commands.apply_commands(*_log(spark, d)))


@query("apply_to_collections", with_(COLLECTIONS, COMMANDS, FOLD) + """
SELECT owner_id, collection_id, name, created_at FROM after_log""")
def _(spark, d):
    return commands.apply_to_collections(s.collections(spark, d), s.commands(spark, d))


@query("mark_opened", with_(LIBRARY, COMMANDS) + """
SELECT l.doc_id, coalesce(o.at, l.last_opened_at) AS last_opened_at FROM library l LEFT JOIN
(SELECT doc_id, arg_max(ts, seq) AS at FROM commands WHERE op = 'mark_opened' GROUP BY 1) o USING (doc_id)""")
def _(spark, d):
    return commands.mark_opened(s.library(spark, d), s.commands(spark, d)).select("doc_id", "last_opened_at")


@query("set_favorite", with_(LIBRARY, COMMANDS) + """
SELECT l.doc_id, coalesce(o.v, l.is_favorite) AS is_favorite FROM library l LEFT JOIN
(SELECT doc_id, arg_max(bool_value, seq) AS v FROM commands WHERE op = 'set_favorite' GROUP BY 1) o USING (doc_id)""")
def _(spark, d):
    return commands.set_favorite(s.library(spark, d), s.commands(spark, d)).select("doc_id", "is_favorite")


@query("toggle_favorite", with_(LIBRARY, COMMANDS) + """
SELECT l.doc_id, l.is_favorite <> (coalesce(o.n, 0) % 2 = 1) AS is_favorite FROM library l LEFT JOIN
(SELECT doc_id, count(*) AS n FROM commands WHERE op = 'toggle_favorite' GROUP BY 1) o USING (doc_id)""")
def _(spark, d):
    return commands.toggle_favorite(s.library(spark, d), s.commands(spark, d)).select("doc_id", "is_favorite")


@query("rename", with_(LIBRARY, COMMANDS) + """
SELECT l.doc_id, coalesce(o.v, l.display_name) AS display_name, l.size_bytes FROM library l LEFT JOIN
(SELECT doc_id, arg_max(str_value, seq) AS v FROM commands WHERE op = 'rename' GROUP BY 1) o USING (doc_id)""")
def _(spark, d):
    return commands.rename(s.library(spark, d), s.commands(spark, d)).select("doc_id", "display_name", "size_bytes")


@query("move", with_(LIBRARY, COLLECTIONS, COMMANDS, FOLD) + """
SELECT l.doc_id, CASE WHEN m.doc_id IS NULL THEN l.collection_id ELSE m.moved.v END AS collection_id
FROM library l LEFT JOIN moves m USING (doc_id)""")
def _(spark, d):
    return commands.move(*_log(spark, d)).select("doc_id", "collection_id")


@query("delete_documents", with_(LIBRARY) + f"""
SELECT {COLS} FROM library WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99)""")
def _(spark, d):
    log = s.table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("value") > 99)).select(
        F.col("user_id").alias("doc_id"), F.lit("delete").alias("op"))
    return flat(commands.delete_documents(s.library(spark, d), log))


@query("create_collections", with_(COLLECTIONS) + f"""
SELECT owner_id, collection_id, name, created_at FROM collections
UNION ALL
SELECT source, 4 + row_number() OVER (ORDER BY doc_id, source), 'Box ' || lang, TIMESTAMP '{NOW}' FROM documents""")
def _(spark, d):
    asked = s.table(spark, d, "documents").select(
        F.col("source").alias("owner_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("Box "), "lang").alias("name"))
    return commands.create_collections(s.collections(spark, d), asked, NOW)


@query("rename_collections", with_(COLLECTIONS) + """
SELECT c.owner_id, c.collection_id, coalesce(n.name, c.name) AS name, c.created_at FROM collections c LEFT JOIN
(SELECT source AS owner_id, CASE lang WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END::BIGINT AS collection_id,
        arg_max('n' || doc_id, doc_id) AS name FROM documents WHERE lang <> 'en' GROUP BY 1, 2) n USING (owner_id, collection_id)""")
def _(spark, d):
    log = s.table(spark, d, "documents").where(F.col("lang") != "en").select(
        F.col("source").alias("owner_id"), s.collection_of(F.col("lang")).alias("collection_id"),
        F.col("doc_id").alias("seq"), F.lit("rename_collection").alias("op"),
        F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("str_value"))
    return commands.rename_collections(s.collections(spark, d), log)


@query("delete_collections", with_(LIBRARY) + f"""
SELECT {COLS.replace('collection_id', 'CASE WHEN collection_id <> 2 THEN collection_id END AS collection_id')} FROM library""")
def _(spark, d):
    cols = s.collections(spark, d)
    return flat(commands.delete_collections(s.library(spark, d), cols, cols.where(F.col("name") == "ES"))[0])


@query("latest_value", with_(COMMANDS) + """
SELECT doc_id, op, max(seq) AS seq, arg_max({'v': collection_id}, seq).v AS collection_id,
       arg_max({'v': str_value}, seq).v AS str_value, arg_max({'v': bool_value}, seq).v AS bool_value,
       arg_max({'v': ts}, seq).v AS ts FROM commands WHERE doc_id IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return commands.latest_value(s.commands(spark, d))
