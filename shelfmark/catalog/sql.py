"""DuckDB twins of the views in ``sources.sample_tables``, used as common table expressions."""

PLACE = "CASE {0} WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END::BIGINT"
NAME = "d.source || '/' || d.lang || '-' || d.doc_id || '.pdf'"

LIBRARY = f"""
library AS (
  SELECT d.source AS owner_id, d.doc_id,
         CASE WHEN strlen(d.text) < 1000 THEN 'external' ELSE 'managed' END AS kind,
         sha256(d.text) AS content_hash, {NAME} AS display_name,
         strlen(d.text)::BIGINT AS size_bytes,
         TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS added_at, e.last_opened_at,
         g.doc_id IS NOT NULL AS is_favorite,
         len(string_split(d.text, chr(10)))::INTEGER AS page_count,
         {PLACE.format('d.lang')} AS collection_id
  FROM documents d
  LEFT JOIN (SELECT user_id, max(ts) AS last_opened_at FROM events GROUP BY 1) e ON e.user_id = d.doc_id
  LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON g.doc_id = d.doc_id
)"""

COLLECTIONS = f"""
collections AS (
  SELECT DISTINCT source AS owner_id, {PLACE.format('lang')} AS collection_id, upper(lang) AS name,
         TIMESTAMP '2024-01-01' AS created_at
  FROM documents WHERE lang <> 'en'
  UNION ALL
  SELECT DISTINCT source, 4::BIGINT, 'Empty', TIMESTAMP '2024-01-01' FROM documents
)"""

PAGES = """
page_text AS (
  SELECT doc_id, (unnest(range(1, len(parts) + 1)) - 1)::INTEGER AS page_index, unnest(parts) AS full_text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
)"""

COMMANDS = """
named AS (
  SELECT e.*, CASE e.event_id % 97 WHEN 3 THEN 'delete' WHEN 10 THEN 'create_collection'
    WHEN 40 THEN 'rename_collection' WHEN 70 THEN 'delete_collection' ELSE
    CASE e.event_type WHEN 'view' THEN 'mark_opened' WHEN 'click' THEN 'toggle_favorite'
      WHEN 'signup' THEN 'set_favorite' WHEN 'purchase' THEN 'move' WHEN 'error' THEN 'rename' END END AS op
  FROM events e),
commands AS (
  SELECT d.source AS owner_id, e.event_id AS seq, e.op,
         CASE WHEN e.op NOT LIKE '%collection' THEN e.user_id END AS doc_id,
         CASE WHEN e.op LIKE '%collection' THEN e.event_id % 7 + 1
              WHEN e.op = 'move' AND floor(e.value)::BIGINT % 8 <> 0 THEN floor(e.value)::BIGINT % 8 END AS collection_id,
         CASE WHEN e.op IN ('rename', 'create_collection', 'rename_collection') THEN 'n' || e.event_id END AS str_value,
         CASE WHEN e.op = 'set_favorite' THEN e.value > 50 END AS bool_value,
         e.ts
  FROM named e LEFT JOIN documents d ON d.doc_id = e.user_id
)"""

# A collection exists at a point of the log if its last creation or deletion before was a creation.
FOLD = """
edges AS (
  SELECT owner_id, collection_id, seq, op = 'create_collection' AS made, str_value AS name, ts FROM commands
  WHERE op IN ('create_collection', 'delete_collection')
  UNION ALL SELECT owner_id, collection_id, -1, true, name, created_at FROM collections),
placed AS (
  SELECT c.doc_id, c.seq, c.collection_id,
    (SELECT arg_max(e.made, e.seq) FROM edges e
     WHERE e.owner_id = c.owner_id AND e.collection_id = c.collection_id AND e.seq < c.seq) AS there,
    EXISTS (SELECT 1 FROM edges e WHERE e.owner_id = c.owner_id AND e.collection_id = c.collection_id
            AND e.seq > c.seq AND NOT e.made) AS emptied
  FROM commands c WHERE c.op = 'move'),
moves AS (
  SELECT doc_id, arg_max({'v': CASE WHEN NOT emptied THEN collection_id END}, seq) AS moved FROM placed
  WHERE collection_id IS NULL OR there GROUP BY 1),
cleared AS (
  SELECT DISTINCT owner_id, collection_id FROM commands JOIN collections USING (owner_id, collection_id)
  WHERE op = 'delete_collection'),
lasts AS (
  SELECT owner_id, collection_id, max(seq) FILTER (NOT made) AS last_death FROM edges GROUP BY 1, 2),
kept AS (
  SELECT owner_id, collection_id, min(seq) AS born, arg_min({'n': name, 't': ts}, seq) AS made
  FROM edges JOIN lasts USING (owner_id, collection_id) WHERE made AND seq > coalesce(last_death, -2) GROUP BY 1, 2),
after_log AS (
  SELECT k.owner_id, k.collection_id, coalesce((SELECT arg_max(c.str_value, c.seq) FROM commands c
    WHERE c.op = 'rename_collection' AND c.owner_id = k.owner_id AND c.collection_id = k.collection_id AND c.seq > k.born),
    k.made.n) AS name, k.made.t AS created_at FROM kept k),
sets AS (SELECT doc_id, max(seq) AS set_seq, arg_max(bool_value, seq) AS val FROM commands WHERE op = 'set_favorite' GROUP BY 1),
toggles AS (SELECT c.doc_id, count(*) AS n FROM commands c LEFT JOIN sets s USING (doc_id)
  WHERE c.op = 'toggle_favorite' AND (s.set_seq IS NULL OR c.seq > s.set_seq) GROUP BY 1),
opened AS (SELECT doc_id, arg_max(ts, seq) AS at FROM commands WHERE op = 'mark_opened' GROUP BY 1),
renamed AS (SELECT doc_id, arg_max(str_value, seq) AS name FROM commands WHERE op = 'rename' GROUP BY 1)"""

OPLOG = """
oplog AS (
  SELECT event_id::VARCHAR AS op_id, 'end' AS phase,
         CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS op,
         substr(sha256(user_id::VARCHAR), 1, 16) AS file_hash,
         strlen(props)::BIGINT AS bytes,
         CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result,
         round(value)::BIGINT AS ms,
         CASE WHEN event_type = 'error' THEN ['document_corrupt','document_moved','permission_revoked',
              'password_required','wrong_password','unsupported_feature','storage_full','unknown'][event_id % 8 + 1] END AS code,
         CASE WHEN event_type = 'error' THEN props END AS detail,
         ts
  FROM events
)"""

OUTLINE = """
outline_nodes AS (
  SELECT 1::BIGINT AS doc_id, 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id,
         r_regionkey::INTEGER AS ord, r_name AS title, NULL::INTEGER AS page_index FROM region
  UNION ALL
  SELECT 1, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name, n_nationkey FROM nation
  UNION ALL
  SELECT 1, 's' || s_suppkey, 'n' || s_nationkey, s_suppkey::INTEGER, s_name, s_suppkey::INTEGER FROM supplier
)"""

FILES = """
files AS (
  SELECT d.source || '/' || d.doc_id || '.pdf' AS path, g.doc_id IS NOT NULL AS good,
         CASE WHEN g.doc_id IS NOT NULL THEN '%PDF-1.7' || chr(10) ELSE '' END
         || replace(d.text, chr(10), chr(10) || '/Type /Page ' || chr(10))
         || CASE WHEN g.doc_id IS NOT NULL THEN chr(10) || '%%EOF' ELSE '' END AS body
  FROM documents d
  LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON g.doc_id = d.doc_id
)"""


def hits(query: str, source: str = "page_text", keys: str = "doc_id, page_index") -> str:
    """CTE ``hits`` with the offsets of every match of ``query``."""
    q = query.replace("'", "''").lower()
    n = len(query)
    return f"""
parts AS (SELECT {keys}, full_text, string_split(lower(full_text), '{q}') AS p FROM {source}),
hits AS (
  SELECT {keys}, full_text, len(p) AS pieces,
         (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {n})::INTEGER AS "offset"
  FROM (SELECT *, unnest(range(1, len(p))) AS i FROM parts)
)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(ctes) + "\n"
