"""Checks over names, texts and keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.text import let
from shelfmark.operators.terms import few, match_numbers, matches


def _listed(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("term").alias("__term"), F.lower("term").alias("__word")).distinct()


def _in_row(listed: DataFrame) -> Column:
    """A short list of terms as one array."""
    return listed.agg(F.collect_list(F.struct("__term", "__word"))).scalar()


def terms_found(texts: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """Rows of ``texts`` (without the text) with every term that occurs in the text.

    The comparison is literal and ignores case. Each text is scanned once where it lies, whatever the
    number of terms, and only matching pairs are produced; no text is shuffled.
    """
    kept = [c for c in texts.columns if c != text]
    listed = _listed(terms)
    if few(listed):
        hits = let(F.lower(F.col(text)), lambda t: F.filter(F.col("__pack"), lambda x: F.contains(t, x["__word"])))
        found = texts.withColumn("__pack", _in_row(listed)).select(*kept, F.explode(hits).alias("__hit"))
        return found.select(*kept, F.col("__hit.__term").alias("term"))
    folded = texts.select(*kept, F.lower(text).alias("__text"))
    found = matches(folded, "__text", listed, "__word").select(*kept, F.col("__term").alias("term"))
    blank = listed.where(F.col("__word") == "")
    if blank.isEmpty():
        return found
    return found.union(folded.where("__text IS NOT NULL").select(*kept, F.lit("").alias("term")))


def deny_list_hits(items: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Every ``(item, term)`` whose text holds a denied term; ``items`` is ``(item, text)``."""
    if terms is None:
        terms = schemas.deny_terms(items.sparkSession)
    return terms_found(items.select("item", "text"), "text", terms)


def deny_list_verdict(items: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row per item with the number of denied terms; any hit fails the item.

    A short list is counted inside each row, a long one by the pieces of the text.
    """
    if terms is None:
        terms = schemas.deny_terms(items.sparkSession)
    listed = _listed(terms)
    if few(listed):
        count = let(F.lower("text"), lambda t: F.size(F.filter(F.col("__pack"), lambda x: F.contains(t, x["__word"]))))
        counted = items.withColumn("__pack", _in_row(listed)).select("item", count.cast("bigint").alias("denied_terms"))
    else:
        blank = listed.where(F.col("__word") == "").count()
        rows = items.select("item", F.lower("text").alias("__text"), F.when(F.col("text").isNotNull(), blank).otherwise(0).alias("__blank"))
        counted = match_numbers(rows, "__text", listed, "__word").select(
            "item", (F.col("n") + F.col("__blank")).cast("bigint").alias("denied_terms"))
    return counted.withColumn("passed", F.col("denied_terms") == 0)


def undocumented(names: DataFrame, records: DataFrame) -> DataFrame:
    """The set of names (``name``) that equal no ``name`` in ``records``."""
    return names.select("name").distinct().join(records.select("name").distinct(), "name", "left_anti")


def unmentioned(names: DataFrame, record_texts: DataFrame) -> DataFrame:
    """Names (``name``) that occur, case-sensitively, in no ``text`` of the record.

    The record is read once, whatever the number of names.
    """
    listed = names.select(F.col("name").alias("__word")).distinct()
    texts = record_texts.select(F.col("text").alias("__text"))
    if few(listed):
        pack = listed.agg(F.collect_list("__word")).scalar()
        hits = F.filter(F.col("__pack"), lambda x: F.contains(F.col("__text"), x))
        mentioned = texts.withColumn("__pack", pack).select(F.explode(hits).alias("__word"))
    else:
        mentioned = matches(texts, "__text", listed, "__word").select("__word")
        blank = texts.where("__text IS NOT NULL").limit(1).select(F.lit("").alias("__word"))
        mentioned = mentioned.union(blank)
    return listed.join(mentioned.distinct(), "__word", "left_anti").select(F.col("__word").alias("name"))


def attach_failure_message(rows: DataFrame) -> DataFrame:
    """Title and body for each ``failure_code``; the dimension has exactly eight rows."""
    messages = schemas.failure_messages(rows.sparkSession).withColumnRenamed("code", "failure_code")
    return rows.join(F.broadcast(messages), "failure_code", "left")


def collection_counts(library: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents and bytes per collection, the root as its own group, empty ones at zero.

    The library is aggregated before the join, so both sides have one row per collection.
    """
    held = library.groupBy("owner_id", "collection_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("size_bytes").alias("bytes")
    )
    listed = collections.select("owner_id", "collection_id", "name")
    h, c = held.alias("h"), listed.alias("c")
    same = (F.col("h.owner_id") == F.col("c.owner_id")) & F.col("h.collection_id").eqNullSafe(F.col("c.collection_id"))
    return h.join(c, same, "full").select(
        F.coalesce("h.owner_id", "c.owner_id").alias("owner_id"),
        F.coalesce("h.collection_id", "c.collection_id").alias("collection_id"),
        F.col("c.name").alias("name"),
        F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"),
        F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
    )


def assert_unique(rows: DataFrame, key: str) -> DataFrame:
    """One row: totals, distinct keys, blank keys and whether the key is a proper key.

    Grouping by the key first lets a repeated key combine before the shuffle.
    """
    per_key = rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.coalesce(F.col("k"), F.lit("")) == ""
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("k").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank_keys"),
    ).withColumn("is_unique", (F.col("total") == F.col("distinct_keys")) & (F.col("blank_keys") == 0))
