"""File intake, content addressing and duplicate accounting."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.documents import address_of, content_hash, has_pdf_magic
from shelfmark.session import cut_lineage


def classify_intake(files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row per file with ``failure_code`` null when the file is accepted.

    Paths of ``requested`` (``path``) without a file are reported as rows of their own.
    The bytes are judged where they are read; only paths are shuffled to find the missing.
    """
    bad = ~F.coalesce((F.col("length") >= 4) & has_pdf_magic(F.col("content")), F.lit(False))
    code, detail = F.when(bad, "document_corrupt"), F.when(bad, "missing %PDF header")
    if "failure_code" in files.columns:  # found when the file was listed
        earlier = F.col("failure_code").isNotNull()
        code = F.when(earlier, F.col("failure_code")).otherwise(code)
        detail = F.when(earlier, F.col("failure_detail")).otherwise(detail)
    kept = [c for c in files.columns if c not in ("failure_code", "failure_detail")]
    rows = files.select(*kept, code.alias("failure_code"), detail.alias("failure_detail"))
    if requested is None:
        return rows
    missing = requested.select("path").distinct().join(files.select("path"), "path", "left_anti").select(
        "path",
        F.lit("document_moved").alias("failure_code"),
        F.lit("source file does not exist").alias("failure_detail"),
    )
    return rows.unionByName(missing, allowMissingColumns=True)


def content_address(files: DataFrame) -> DataFrame:
    """Hash, storage path and size; the bytes do not travel further than this."""
    size = F.coalesce(F.octet_length("content"), F.col("length")) if "length" in files.columns else F.octet_length("content")
    hashed = files.withColumn("content_hash", content_hash(F.col("content"))).withColumn("__size", size)
    kept = [c for c in files.columns if c not in ("content", "length")]
    return hashed.select(
        *kept,
        "content_hash",
        address_of(F.col("content_hash")).alias("relative_path"),
        F.col("__size").cast("bigint").alias("size_bytes"),
    )


def triage_bytes(files: DataFrame) -> DataFrame:
    """Audit without a parser: page objects, end marker, encryption and script markers."""
    raw = F.expr("decode(content, 'ISO-8859-1')")
    return files.select(
        "path",
        F.regexp_count(raw, F.lit(r"/Type\s*/Page[^s]")).cast("bigint").alias("page_objects"),
        F.contains(raw, F.lit("%%EOF")).alias("has_eof"),
        F.contains(raw, F.lit("/Encrypt")).alias("has_encrypt"),
        F.contains(raw, F.lit("/JavaScript")).alias("has_javascript"),
    )


OWNED = ("owner_id", "content_hash")
GLOBAL = ("content_hash",)


def duplicate_groups(library: DataFrame, keys: Sequence[str] = OWNED) -> DataFrame:
    """Content held by more than one row of a library: number of copies and the row to keep.

    A library belongs to one owner; ``keys=GLOBAL`` accounts for content across all of them. Files left
    in place have no hash and are nobody's duplicate.
    """
    return (
        library.where(F.col("content_hash").isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keeper"))
        .where(F.col("copies") > 1)
    )


def duplicate_members(library: DataFrame, keys: Sequence[str] = OWNED) -> DataFrame:
    """The members of every duplicate group, one row each.

    A group may hold a large share of the library, so its ids are not collected into an
    array; ordering the rows by hash and id gives the sorted member list. The hashes are taken
    once; a crowded group is split by adaptive execution.
    """
    rows = cut_lineage(library.where(F.col("content_hash").isNotNull()).select(*keys, "doc_id"))
    return rows.join(duplicate_groups(rows, keys), list(keys)).withColumn("is_keeper", F.col("doc_id") == F.col("keeper"))


def distinct_content(library: DataFrame, keys: Sequence[str] = OWNED) -> DataFrame:
    """One row per content hash of a library, the smallest id winning; rows without a hash all stay."""
    others = [c for c in library.columns if c not in keys]
    hashed = library.where(F.col("content_hash").isNotNull())
    kept = hashed.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col("doc_id")).alias("row"))
    return kept.select(*keys, "row.*").select(*library.columns).unionByName(
        library.where(F.col("content_hash").isNull())
    )


def storage_footprint(library: DataFrame) -> DataFrame:
    """Per owner: bytes of all managed rows, bytes stored once per key, bytes saved."""
    by_key = (
        library.where(F.col("ref.kind") == "managed")
        .groupBy("owner_id", "storage_key")
        .agg(F.sum("size_bytes").alias("logical"), F.max("size_bytes").alias("stored"))
    )
    return (
        by_key.groupBy("owner_id")
        .agg(F.sum("logical").alias("logical_bytes"), F.sum("stored").alias("stored_bytes"))
        .withColumn("saved_bytes", F.col("logical_bytes") - F.col("stored_bytes"))
    )


def collectable_files(stored: DataFrame, library: DataFrame) -> DataFrame:
    """Stored files no surviving managed row points at; both sides are unique per key."""
    used = library.where(F.col("ref.kind") == "managed").select("storage_key").distinct()
    return stored.join(used, "storage_key", "left_anti")
