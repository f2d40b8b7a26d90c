"""Resolving references to readable paths or typed failures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.skew import salted_lookup


def handle_key(ref):
    """The text a grant is listed under: path, URI or encoded bookmark."""
    handle = ref["handle"]
    return (
        F.when(handle["type"] == "path", handle["path"])
        .when(handle["type"] == "contentUri", handle["uri"])
        .when(handle["type"] == "bookmark", F.base64(handle["data"]))
    )


def resolve_refs(library: DataFrame, present: DataFrame, grants: DataFrame) -> DataFrame:
    """Every row with ``readable_path`` or a failure code; no row is dropped.

    ``present`` lists existing paths (``path``); ``grants`` lists the outcome of opening
    a handle (``handle``, ``status``), where ``ok`` means readable.
    """
    ref = F.col("ref")
    managed = ref["kind"] == "managed"
    on_disk = managed | (ref["handle"]["type"] == "path")
    # One lookup serves files and handles; the prefix keeps their names apart.
    name = F.when(managed, ref["relative_path"]).otherwise(handle_key(ref))
    wanted = library.withColumn("__name", name).withColumn(
        "__key", F.concat(F.when(on_disk, "file ").otherwise("handle "), "__name")
    )
    outcomes = (
        present.select(F.concat(F.lit("file "), "path").alias("__key"), F.lit("ok").alias("status"))
        .unionByName(grants.select(F.concat(F.lit("handle "), "handle").alias("__key"), "status"))
        .groupBy("__key")
        .agg(F.max("status").alias("__status"))
    )
    joined = salted_lookup(wanted, outcomes, ["__key"], ["doc_id"])
    status = F.coalesce("__status", F.lit("missing"))
    code = (
        F.when(status == "ok", F.lit(None))
        .when(status == "missing", F.lit("document_moved"))
        .when(status.isin("stale", "revoked"), F.lit("permission_revoked"))
        .otherwise(F.lit("unknown"))
    )
    detail = F.when(status != "ok", F.when(managed, F.lit("managed copy is missing"))
                    .when(on_disk, F.lit("path no longer exists")).otherwise(status))
    return (
        joined.withColumn("failure_code", code)
        .withColumn("failure_detail", detail)
        .withColumn("readable_path", F.when(F.col("failure_code").isNull(), F.col("__name")))
        .drop("__name", "__key", "__status")
    )
