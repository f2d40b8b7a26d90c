"""Table schemas and the fixed failure dimension."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HANDLE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("uri", T.StringType()),
    T.StructField("path", T.StringType()),
])

REF = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("relative_path", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("handle", HANDLE),
])

LIBRARY = T.StructType([
    T.StructField("owner_id", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("ref", REF),
    T.StructField("storage_key", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("added_at", T.TimestampNTZType()),
    T.StructField("last_opened_at", T.TimestampNTZType()),
    T.StructField("is_favorite", T.BooleanType()),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("collection_id", T.LongType()),
])

COLLECTIONS = T.StructType([
    T.StructField("owner_id", T.StringType()),
    T.StructField("collection_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

PAGE_INFO = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("width_pt", T.DoubleType()),
    T.StructField("height_pt", T.DoubleType()),
    T.StructField("rotation_quarter_turns", T.IntegerType()),
])

RECT = T.StructType([
    T.StructField("left", T.DoubleType()),
    T.StructField("top", T.DoubleType()),
    T.StructField("right", T.DoubleType()),
    T.StructField("bottom", T.DoubleType()),
])

PAGE_TEXT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("char_rects", T.ArrayType(RECT)),
])

EXTRACTED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("char_rects", T.ArrayType(RECT)),
    T.StructField("failure_code", T.StringType()),
    T.StructField("failure_detail", T.StringType()),
])

OUTLINE_NODES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("page_index", T.IntegerType()),
])

PERMISSIONS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("p_flags", T.IntegerType()),
])

COMMANDS = T.StructType([
    T.StructField("owner_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("collection_id", T.LongType()),
    T.StructField("str_value", T.StringType()),
    T.StructField("bool_value", T.BooleanType()),
    T.StructField("ts", T.TimestampNTZType()),
])

OPLOG = T.StructType([
    T.StructField("op_id", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("result", T.StringType()),
    T.StructField("ms", T.LongType()),
    T.StructField("code", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

FAILURE_MESSAGES_SCHEMA = "code string, title string, body string"

# The failure codes and the English message of each.
FAILURE_MESSAGES = [
    ("document_corrupt", "Unable to open this PDF.",
     "The file may be corrupted or use an unsupported PDF feature."),
    ("document_moved", "This document has moved.",
     "It may have been renamed, moved, or deleted outside the app."),
    ("permission_revoked", "No longer able to open this file.",
     "Permission to read it was withdrawn. Open it again to restore access."),
    ("password_required", "This PDF is password protected.",
     "Enter the password to open it."),
    ("wrong_password", "Incorrect password.",
     "Check the password and try again."),
    ("unsupported_feature", "Unable to display this PDF.",
     "It uses a PDF feature this app does not support yet."),
    ("storage_full", "Not enough storage.",
     "Free up some space and try again."),
    ("unknown", "Something went wrong.",
     "The operation could not be completed."),
]

# Licence texts and vendors that may not occur in a dependency.
DENY_TERMS = [
    "GNU GENERAL PUBLIC LICENSE",
    "GNU LESSER GENERAL PUBLIC",
    "GNU AFFERO",
    "Server Side Public License",
    "Syncfusion",
    "PSPDFKit",
    "Apryse",
    "PDFTron",
]


def failure_messages(spark: SparkSession) -> DataFrame:
    """The eight failure codes with their title and body."""
    return spark.createDataFrame(FAILURE_MESSAGES, FAILURE_MESSAGES_SCHEMA)


def deny_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in DENY_TERMS], "term string")
