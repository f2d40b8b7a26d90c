"""Filters, sorts and row changes over the library table."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.documents import address_of
from shelfmark.functions.text import literal_pattern, may_contain
from shelfmark.operators.intake import classify_intake, content_address
from shelfmark.plans.ranking import with_global_index
from shelfmark.plans.skew import dimension_join, few_against_many

SORT_FIELDS = ("name", "date_added", "date_opened", "size")
ALL = object()
WINDOW_LIMIT = 1000
OWNER_PARTS = 64


def all_documents(library: DataFrame) -> DataFrame:
    return library


def filter_by_name(library: DataFrame, query: str) -> DataFrame:
    """Literal, case-insensitive substring of the display name; a blank query keeps all rows.

    Letters are compared as search compares them: a cheap test first, then the folding pattern.
    """
    needle = query.strip()
    if not needle:
        return library
    name = F.col("display_name")
    return library.where(may_contain(name, needle) & F.rlike(name, literal_pattern(needle)))


def favorites(library: DataFrame) -> DataFrame:
    return library.where(F.col("is_favorite"))


def opened_only(library: DataFrame) -> DataFrame:
    return library.where(F.col("last_opened_at").isNotNull())


def of_owner(library: DataFrame, owner_id: str | None) -> DataFrame:
    """The library of one owner; ``None`` keeps the rows of all."""
    return library if owner_id is None else library.where(F.col("owner_id") == owner_id)


def documents_in(library: DataFrame, collection_id: int | None, owner_id: str) -> DataFrame:
    """Documents of one collection of an owner; a null collection means the owner's root."""
    return of_owner(library, owner_id).where(F.col("collection_id").eqNullSafe(F.lit(collection_id).cast("bigint")))


def in_selected_collection(library: DataFrame, selected=ALL, owner_id: str | None = None) -> DataFrame:
    """All documents (of one owner if named), or those of the owner's selected collection."""
    if selected is ALL:
        return of_owner(library, owner_id)
    if owner_id is None:
        raise ValueError("a collection belongs to an owner: name the owner of the selected one")
    return documents_in(library, selected, owner_id)


def get_document(library: DataFrame, doc_id: int) -> DataFrame:
    """The row with this id; the query fails when there is none."""
    spark = library.sparkSession
    wanted = spark.range(doc_id, doc_id + 1).select(F.col("id").alias("doc_id"))
    found = library.where(F.col("doc_id") == doc_id).withColumn("__found", F.lit(True))
    missing = F.raise_error(F.lit(f"no document with id {doc_id}")).cast("boolean")
    return (
        wanted.join(found, "doc_id", "left")
        .where(F.coalesce("__found", missing))
        .select(*library.columns)
    )


def sort_order(field: str, ascending: bool) -> list:
    """Sort columns; never-opened counts as oldest and ``doc_id`` breaks ties."""
    if field not in SORT_FIELDS:
        raise ValueError(f"unknown sort field: {field}")
    key = {
        "name": F.lower("display_name"),
        "date_added": F.col("added_at"),
        "date_opened": F.col("last_opened_at"),
        "size": F.col("size_bytes"),
    }[field]
    return [key.asc_nulls_first() if ascending else key.desc_nulls_last(), F.col("doc_id").asc()]


def sort_documents(library: DataFrame, field: str = "date_added", ascending: bool = False) -> DataFrame:
    return library.orderBy(*sort_order(field, ascending))


def recents(library: DataFrame, limit: int = 20, owner_id: str | None = None) -> DataFrame:
    """The most recently opened documents (of one owner if named), newest first."""
    return opened_only(of_owner(library, owner_id)).orderBy(*sort_order("date_opened", False)).limit(limit)


def recents_per_owner(library: DataFrame, limit: int = 20) -> DataFrame:
    """``recents`` of every owner at once.

    The rank filter sits directly on the window, so each map task keeps at most
    ``limit`` rows per owner before the shuffle and a very active owner stays small. Spark
    does that for up to ``WINDOW_LIMIT`` rows; for more, an owner's rows are first ranked in
    ``OWNER_PARTS`` parts, and only the best of each part meet.
    """
    order = sort_order("date_opened", False)
    newest = W.partitionBy("owner_id").orderBy(*order)
    rows = opened_only(library)
    if limit > WINDOW_LIMIT:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(OWNER_PARTS))
        rows = rows.withColumn("__part", part).withColumn(
            "__rank", F.row_number().over(W.partitionBy("owner_id", "__part").orderBy(*order))
        ).where(F.col("__rank") <= limit).drop("__part", "__rank")
    return (
        rows
        .withColumn("recent_rank", F.row_number().over(newest))
        .where(F.col("recent_rank") <= limit)
    )


def visible_documents(
    library: DataFrame, query: str = "", field: str = "date_added", ascending: bool = False, selected=ALL,
    owner_id: str | None = None,
) -> DataFrame:
    """What an owner's list shows: collection, then name filter, then sort."""
    chosen = in_selected_collection(library, selected, owner_id)
    return sort_documents(filter_by_name(chosen, query), field, ascending)


def attach_collection(library: DataFrame, collections: DataFrame) -> DataFrame:
    """Document rows with the collection name; root documents keep a null name."""
    names = collections.select("owner_id", "collection_id", F.col("name").alias("collection_name"))
    return dimension_join(library, names, ["owner_id", "collection_id"], ["doc_id"])


def selected_documents(library: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Documents whose id is, or is not, in ``ids``."""
    return library.join(ids.select("doc_id").distinct(), "doc_id", "left_semi" if keep else "left_anti")


def merge_sources(managed: DataFrame, external: DataFrame) -> DataFrame:
    """Imported copies and files left in place in one library."""
    return managed.unionByName(external, allowMissingColumns=True)


def patch_fields(library: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Partial update by ``doc_id``: a null in the patch keeps the old value.

    Of several patches of a document the last by ``seq`` counts (without that column, the one with the
    largest values), so no row is multiplied.
    """
    values = F.struct(*[F.col(f) for f in fields])
    order = F.struct("seq", values) if "seq" in patches.columns else values
    changes = patches.groupBy("doc_id").agg(F.max_by(values, order).alias("__new")).select(
        "doc_id", *[F.col("__new")[f].alias(f"__new_{f}") for f in fields])
    joined = library.join(changes, "doc_id", "left")
    return joined.select(*[
        F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
        for c in library.columns
    ])


def insert_documents(library: DataFrame, batch: DataFrame, now, order: str = "display_name") -> DataFrame:
    """Append ``batch`` with fresh ids and the defaults of a new row.

    Ids continue after the largest one in use, in the order of ``order`` within the
    batch. Only the batch is numbered; the library is read once for its largest id. Many
    rows may share a name, so a hash of the whole row breaks ties and keeps the ranges
    even.
    """
    last = library.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("m")).scalar()
    numbered = with_global_index(batch, [order, F.xxhash64(*batch.columns)], "__rank")
    have = set(batch.columns)
    defaults = {
        "added_at": F.lit(now).cast("timestamp_ntz"),
        "is_favorite": F.lit(False),
        "last_opened_at": F.lit(None),
        "collection_id": F.lit(None),
    }
    columns = []
    for f in library.schema.fields:
        if f.name == "doc_id":
            value = last + F.col("__rank") + 1
        elif f.name in defaults:
            value = defaults[f.name]
        else:
            value = F.col(f.name) if f.name in have else F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return library.unionByName(numbered.select(*columns))


def managed_rows(accepted: DataFrame, owner_id) -> DataFrame:
    """Library rows, without ids, for files that passed intake."""
    return accepted.select(
        owner_id.alias("owner_id"),
        F.struct(
            F.lit("managed").alias("kind"),
            F.col("relative_path"),
            F.col("content_hash"),
            F.lit(None).cast("string").alias("display_name"),
            F.lit(None).cast(schemas.HANDLE).alias("handle"),
        ).alias("ref"),
        F.col("content_hash").alias("storage_key"),
        "content_hash",
        F.element_at(F.split("path", "/"), -1).alias("display_name"),
        "size_bytes",
    )


def register_external(library: DataFrame, files: DataFrame, owner_id, now) -> DataFrame:
    """Add rows for files that stay where they are; their bytes are not addressed."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(
        owner_id.alias("owner_id"),
        F.struct(
            F.lit("external").alias("kind"),
            F.lit(None).cast("string").alias("relative_path"),
            F.lit(None).cast("string").alias("content_hash"),
            name.alias("display_name"),
            F.struct(
                F.lit("path").alias("type"),
                F.lit(None).cast("binary").alias("data"),
                F.lit(None).cast("string").alias("uri"),
                F.col("path"),
            ).alias("handle"),
        ).alias("ref"),
        name.alias("display_name"),
        F.col("length").alias("size_bytes"),
        "path",
    )
    return insert_documents(library, rows, now, order="path")


def upgrade_schema(library: DataFrame, collections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bring a version 1 library to version 2; a version 2 library passes unchanged."""
    if "collection_id" not in library.columns:
        library = library.withColumn("collection_id", F.lit(None).cast("bigint"))
    if collections is None:
        collections = library.sparkSession.createDataFrame([], schemas.COLLECTIONS)
    return library, collections


def import_files(library: DataFrame, files: DataFrame, owner_id: str, now) -> DataFrame:
    """Take accepted files into an owner's library: classify, address, skip known content, insert.

    Content the owner already holds and repeats inside the batch (all but the smallest path) are left out.
    """
    checked = content_address(classify_intake(files)).where(F.col("failure_code").isNull())
    first = checked.groupBy("content_hash").agg(F.min_by(F.struct(*checked.columns), F.col("path")).alias("file")).select("file.*")
    known = of_owner(library, owner_id).where(F.col("ref.kind") == "managed").select("content_hash").distinct()
    fresh = first.join(known, "content_hash", "left_anti")
    return insert_documents(library, managed_rows(fresh, F.lit(owner_id)), now)


def plan_copies(library: DataFrame, requests: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """What each request ``(seq, doc_id)`` has to copy, or why it cannot.

    A managed row is copied from its storage key. A file left in place has to be resolved first: ``contents``
    gives ``(doc_id, content_hash, size_bytes)`` of the sources that could be read. Columns: seq, doc_id,
    source_key (null for a file left in place), content_hash, size_bytes, new_key, failure_code, failure_detail.
    """
    asked = requests.select("seq", "doc_id")
    rows = library.select(
        "doc_id", F.when(F.col("ref.kind") == "managed", F.col("storage_key")).alias("source_key"),
        "content_hash", "size_bytes", F.lit(True).alias("__found"))
    if contents is not None:
        read = contents.select("doc_id", F.col("content_hash").alias("__hash"), F.col("size_bytes").alias("__size"))
        rows = rows.join(read, "doc_id", "left").select(
            "doc_id", "source_key", F.coalesce("content_hash", "__hash").alias("content_hash"),
            F.coalesce("__size", "size_bytes").alias("size_bytes"), "__found")
    found = few_against_many(asked, rows, ["doc_id"], ["seq"])
    missing = asked.join(library.select("doc_id"), "doc_id", "left_anti")
    every = found.unionByName(missing, allowMissingColumns=True)
    gone, unread = F.col("__found").isNull(), F.col("content_hash").isNull()
    return every.select(
        "seq", "doc_id", "source_key", "content_hash", "size_bytes",
        F.when(~unread, F.sha2(F.concat_ws("|", "content_hash", F.col("seq").cast("string")), 256)).alias("new_key"),
        F.when(gone | unread, "document_moved").alias("failure_code"),
        F.when(gone, "no such document").when(unread, "source content is not resolved").alias("failure_detail"),
    )


def duplicate_documents(library: DataFrame, requests: DataFrame, now, contents: DataFrame | None = None) -> DataFrame:
    """Append one copy per request row ``(seq, doc_id)`` that ``plan_copies`` can serve.

    A copy keeps name, size and content hash, gets a storage key of its own and starts
    without favourite, opened time, page count and collection. The key is salted with
    the request's ``seq``, so a repeated run gives the same key.
    """
    planned = plan_copies(library, requests, contents).where(F.col("failure_code").isNull()).select(
        "seq", "doc_id", "new_key", F.col("content_hash").alias("__hash"), F.col("size_bytes").alias("__size"))
    source = few_against_many(planned, library.drop("page_count"), ["doc_id"], ["seq"])
    copies = (
        source.withColumn("storage_key", F.col("new_key"))
        .withColumn("content_hash", F.col("__hash"))
        .withColumn("size_bytes", F.col("__size"))
        .withColumn("display_name", F.concat("display_name", F.lit(" copy")))
        .withColumn("ref", F.struct(
            F.lit("managed").alias("kind"),
            address_of(F.col("storage_key")).alias("relative_path"),
            F.col("content_hash"),
            F.lit(None).cast("string").alias("display_name"),
            F.lit(None).cast(schemas.HANDLE).alias("handle"),
        ))
        .drop("doc_id", "new_key", "__hash", "__size")
    )
    return insert_documents(library, copies, now, order="seq")
