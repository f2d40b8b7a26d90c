"""The library tables as views over the sample parquet tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.documents import address_of
from shelfmark.functions.text import grid_rects
from shelfmark.plans.skew import dimension_join
from shelfmark.schemas import HANDLE

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
EXTERNAL_BELOW = 1_000  # bytes; smaller files count as opened in place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def collection_of(lang):
    """Collection of a document by language; English sits at the root."""
    return (
        F.when(lang == "de", F.lit(1)).when(lang == "es", F.lit(2)).when(lang == "fr", F.lit(3)).cast("bigint")
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One library per source; opened times come from ``events``, favourites from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    opened = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(
        F.max("ts").alias("last_opened_at")
    )
    liked = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id").distinct()
    digest = F.sha2("text", 256)
    size = F.octet_length("text").cast("bigint")
    external = size < EXTERNAL_BELOW
    name = F.concat("source", F.lit("/"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    uri = F.concat(F.lit("content://"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    rows = docs.select(
        F.col("source").alias("owner_id"),
        "doc_id",
        F.struct(
            F.when(external, "external").otherwise("managed").alias("kind"),
            F.when(~external, address_of(digest)).alias("relative_path"),
            F.when(~external, digest).alias("content_hash"),
            F.when(external, name).alias("display_name"),
            F.when(external, F.struct(
                F.lit("contentUri").alias("type"),
                F.lit(None).cast("binary").alias("data"),
                uri.alias("uri"),
                F.lit(None).cast("string").alias("path"),
            )).otherwise(F.lit(None).cast(HANDLE)).alias("handle"),
        ).alias("ref"),
        digest.alias("storage_key"),
        digest.alias("content_hash"),
        name.alias("display_name"),
        size.alias("size_bytes"),
        F.expr(f"timestampadd(MINUTE, doc_id, {EPOCH})").alias("added_at"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("page_count"),
        collection_of(F.col("lang")).alias("collection_id"),
    )
    return (
        rows.join(opened, "doc_id", "left")
        .join(liked.withColumn("__liked", F.lit(True)), "doc_id", "left")
        .select(
            "owner_id", "doc_id", "ref", "storage_key", "content_hash", "display_name", "size_bytes",
            "added_at", "last_opened_at", F.coalesce("__liked", F.lit(False)).alias("is_favorite"),
            "page_count", "collection_id",
        )
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source one collection for each language but English, and an empty one."""
    docs = table(spark, sf_dir, "documents")
    used = docs.where(F.col("lang") != "en").select(
        F.col("source").alias("owner_id"), collection_of(F.col("lang")).alias("collection_id"),
        F.upper("lang").alias("name"),
    ).distinct()
    empty = docs.select(
        F.col("source").alias("owner_id"), F.lit(4).cast("bigint").alias("collection_id"), F.lit("Empty").alias("name")
    ).distinct()
    return used.unionByName(empty).withColumn("created_at", F.expr(EPOCH))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is a page."""
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("page_index", "full_text")
    )


def page_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(spark, sf_dir).withColumn("char_rects", grid_rects(F.col("full_text")))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a command log on the document named by ``user_id``.

    Every 97th event deletes a document; three others create, rename and delete collections 1 to 7 of
    the document's owner, so collections are changed before they exist and come back after deletion.
    """
    owners = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.col("source").alias("owner_id"))
    events = dimension_join(table(spark, sf_dir, "events"), owners, ["user_id"], ["event_id"])
    kind = F.col("event_type")
    slot = F.pmod("event_id", F.lit(97))
    op = (
        F.when(slot == 3, "delete").when(slot == 10, "create_collection").when(slot == 40, "rename_collection")
        .when(slot == 70, "delete_collection")
        .when(kind == "view", "mark_opened").when(kind == "click", "toggle_favorite")
        .when(kind == "signup", "set_favorite").when(kind == "purchase", "move").when(kind == "error", "rename")
    )
    place = F.pmod(F.floor("value"), F.lit(8)).cast("bigint")
    on_collection = F.col("op").isin("create_collection", "rename_collection", "delete_collection")
    return events.withColumn("op", op).select(
        "owner_id",
        F.col("event_id").alias("seq"),
        "op",
        F.when(~on_collection, F.col("user_id")).alias("doc_id"),
        F.when(on_collection, F.pmod("event_id", F.lit(7)) + 1)
        .when((F.col("op") == "move") & (place != 0), place).alias("collection_id"),
        F.when(F.col("op").isin("rename", "create_collection", "rename_collection"),
               F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("str_value"),
        F.when(F.col("op") == "set_favorite", F.col("value") > 50).alias("bool_value"),
        "ts",
    )


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as end records; errors are failed views."""
    failed = F.col("event_type") == "error"
    codes = ["document_corrupt", "document_moved", "permission_revoked", "password_required",
             "wrong_password", "unsupported_feature", "storage_full", "unknown"]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("op_id"),
        F.lit("end").alias("phase"),
        F.when(failed, "view").otherwise(F.col("event_type")).alias("op"),
        F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("file_hash"),
        F.octet_length("props").cast("bigint").alias("bytes"),
        F.when(failed, "failure").otherwise("success").alias("result"),
        F.round("value").cast("bigint").alias("ms"),
        F.when(failed, F.element_at(F.array(*map(F.lit, codes)), (F.pmod("event_id", F.lit(8)) + 1).cast("int"))).alias("code"),
        F.when(failed, F.col("props")).alias("detail"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as one outline of three levels."""
    region = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("title"),
        F.lit(None).cast("int").alias("page_index"))
    nation = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"),
        F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("title"),
        F.col("n_nationkey").cast("int").alias("page_index"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"),
        F.col("s_suppkey").cast("int").alias("ord"), F.col("s_name").alias("title"),
        F.col("s_suppkey").cast("int").alias("page_index"))
    return region.unionByName(nation).unionByName(supplier).withColumn("doc_id", F.lit(1).cast("bigint"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file bytes; those without the quality label lack the PDF header.

    Every line starts a page object, so the audit has something to count.
    """
    docs = documents(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id").distinct()
    body = F.concat(
        F.when(F.col("__good"), F.lit("%PDF-1.7\n")).otherwise(F.lit("")),
        F.replace("text", F.lit("\n"), F.lit("\n/Type /Page \n")),
        F.when(F.col("__good"), F.lit("\n%%EOF")).otherwise(F.lit("")),
    )
    content = F.encode(body, "UTF-8")
    return dimension_join(docs, good.withColumn("__good", F.lit(True)), ["doc_id"], ["doc_id"]).select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )
