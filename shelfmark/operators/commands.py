"""State changes as one fold over a command log."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.plans.ranking import with_global_index
from shelfmark.plans.skew import dimension_join, measured_small
from shelfmark.session import cut_lineage

DOCUMENT_OPS = ("mark_opened", "set_favorite", "toggle_favorite", "rename", "move", "delete")
RANGE = 1 << 20
COLLECTION_OPS = ("create_collection", "rename_collection", "delete_collection")


def _only(op: str):
    return F.col("op") == op


def latest_value(commands: DataFrame) -> DataFrame:
    """The last command per document and kind; combined before the shuffle."""
    payload = ["seq", "collection_id", "str_value", "bool_value", "ts"]
    return (
        commands.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id", "op")
        .agg(F.max_by(F.struct(*payload), F.col("seq")).alias("last"))
        .select("doc_id", "op", "last.*")
    )


def collection_lives(collections: DataFrame, commands: DataFrame) -> DataFrame:
    """Every time a collection exists: one row from its creation to its deletion, with its last name.

    ``born`` is null for a collection the table already holds, ``died`` for one that remains. A
    command on a row that does not exist does nothing, so of repeated creations or deletions only the
    first counts, and a name counts only between birth and death. The windows run over the creations
    and deletions of one collection; all other commands are combined before they meet it.
    """
    keys = ["owner_id", "collection_id"]
    known = collections.select(
        *keys, F.lit(None).cast("bigint").alias("seq"), F.lit("create_collection").alias("op"),
        F.col("name").alias("str_value"), F.col("created_at").alias("ts"))
    edges = known.unionByName(
        commands.where(F.col("op").isin("create_collection", "delete_collection")).select(*known.columns))
    order = W.partitionBy(*keys).orderBy(F.col("seq").asc_nulls_first())
    turns = edges.withColumn("__before", F.lag("op").over(order)).where(
        ~F.col("op").eqNullSafe(F.coalesce("__before", F.lit("delete_collection"))))
    lives = turns.withColumn("died", F.lead("seq").over(order)).where(_only("create_collection")).select(
        *keys, F.col("seq").alias("born"), "died", F.col("str_value").alias("name"), F.col("ts").alias("created_at"))
    names = commands.where(_only("rename_collection")).select(*keys, "seq", F.col("str_value").alias("new_name"))
    spans = lives.select(*keys, "born", "died")
    renamed = dimension_join(names, spans, keys, ["seq"], "inner").where(_alive()).groupBy(*keys, "born").agg(
        F.max_by("new_name", "seq").alias("new_name"), F.lit(True).alias("__renamed"))
    return _named(lives, renamed, keys)


def _named(lives: DataFrame, renamed: DataFrame, keys: list[str]) -> DataFrame:
    key = F.coalesce("born", F.lit(-1))
    joined = lives.withColumn("__born", key).join(
        renamed.withColumn("__born", key).drop("born"), [*keys, "__born"], "left")
    name = F.when(F.col("__renamed"), F.col("new_name")).otherwise(F.col("name"))
    return joined.select(*keys, "born", "died", name.alias("name"), "created_at")


def _alive():
    return F.coalesce(F.col("born") < F.col("seq"), F.lit(True)) & F.coalesce(F.col("died") > F.col("seq"), F.lit(True))


def apply_to_collections(collections: DataFrame, commands: DataFrame) -> DataFrame:
    """The collections that remain after the log."""
    return collection_lives(collections, commands).where(F.col("died").isNull()).select(*collections.columns)


def last_places(lives: DataFrame, commands: DataFrame) -> DataFrame:
    """(doc_id, moved_seq, moved) of the last move to the root or into a collection that exists then.

    A collection that is deleted afterwards leaves its documents at the root.
    """
    moves = commands.where(_only("move") & F.col("doc_id").isNotNull()).select("owner_id", "doc_id", "seq", "collection_id")
    spans = lives.select("owner_id", "collection_id", "born", "died", F.lit(True).alias("__there"))
    joined = dimension_join(moves, spans, ["owner_id", "collection_id"], ["seq"])
    valid = joined.where(F.col("collection_id").isNull() | (F.coalesce("__there", F.lit(False)) & _alive()))
    place = F.when(F.col("died").isNull(), F.col("collection_id"))
    return valid.groupBy("doc_id").agg(F.max("seq").alias("moved_seq"), F.max_by(place, F.col("seq")).alias("moved"))


def favorite_writes():
    """A favourite command as a function of the flag: set it or not, then flip it or not; null for other commands."""
    is_set = _only("set_favorite")
    return F.when(_only("set_favorite") | _only("toggle_favorite"), F.struct(
        F.col("seq").cast("bigint").alias("seq"), is_set.alias("is_set"), F.when(is_set, F.col("bool_value")).alias("value"),
        (~is_set).alias("odd")))


def composed(writes):
    """Favourite functions of an array, applied one after the other by ``seq``, as one such function."""
    same = F.struct(F.lit(-1).cast("bigint").alias("seq"), F.lit(False).alias("is_set"),
                    F.lit(None).cast("boolean").alias("value"), F.lit(False).alias("odd"))
    return F.aggregate(F.sort_array(writes), same, lambda a, b: F.struct(
        b["seq"].alias("seq"), (a["is_set"] | b["is_set"]).alias("is_set"),
        F.when(b["is_set"], b["value"]).otherwise(a["value"]).alias("value"),
        F.when(b["is_set"], b["odd"]).otherwise(a["odd"] != b["odd"]).alias("odd")))


def document_changes(lives: DataFrame, commands: DataFrame, small: bool | None = None) -> DataFrame:
    """What the log does to each document, as one row: last writes with their ``seq``, deletion and favourite function.

    A command becomes such a row where it is read; rows are then composed within ranges of ``RANGE`` numbers and at
    last by document, so the log is read once. Of a document that
    holds a third of the log no task gets more than the favourite commands of a range, and the last step gets one row
    for each range. Moves count when their collection exists at that point; a collection deleted
    afterwards leaves its documents at the root.
    """
    doc = commands.where(F.col("doc_id").isNotNull() & F.col("op").isin(*DOCUMENT_OPS))
    spans = lives.select("owner_id", F.col("collection_id").alias("__target"), "born", "died", F.lit(True).alias("__there"))
    placed = dimension_join(
        doc.withColumn("__target", F.when(_only("move"), F.col("collection_id"))), spans, ["owner_id", "__target"], ["seq"],
        small=small)
    valid = F.col("__target").isNull() | (F.coalesce("__there", F.lit(False)) & _alive())
    written = {
        "opened": (_only("mark_opened"), F.col("ts")),
        "renamed": (_only("rename"), F.col("str_value")),
        "moved": (_only("move") & valid, F.when(F.col("died").isNull(), F.col("__target"))),
    }
    # A collection with several lives gives a move a row for each; at most one of them is valid.
    state = placed.select(
        "doc_id", "seq", _only("delete").alias("deleted"), favorite_writes().alias("favorite"),
        *[c for name, (when, value) in written.items()
          for c in (F.when(when, F.col("seq")).alias(f"{name}_seq"), F.when(when, value).alias(name))],
    )
    whole = [
        F.max("deleted").alias("deleted"), composed(F.collect_list("favorite")).alias("favorite"),
        *[c for name in written for c in (
            F.max_by(name, f"{name}_seq").alias(name), F.max(f"{name}_seq").alias(f"{name}_seq"))],
    ]
    ranges = state.groupBy("doc_id", F.floor(F.col("seq") / RANGE).alias("range")).agg(*whole)
    return ranges.groupBy("doc_id").agg(*whole)


def apply_commands(library: DataFrame, collections: DataFrame, commands: DataFrame) -> DataFrame:
    """Library after the log: last write per field, toggle parity, deletes and dropped moves.

    The lives of the collections are folded first and stored; the commands on documents are then read
    once and combined to one row per document before they meet the library.
    """
    lives = cut_lineage(collection_lives(collections, commands))
    small = measured_small(lives)
    gone = lives.where(F.col("born").isNull() & F.col("died").isNotNull()).select(
        "owner_id", "collection_id", F.lit(True).alias("__gone"))

    def written(name, old):
        return F.when(F.col(f"{name}_seq").isNotNull(), F.col(name)).otherwise(F.col(old))

    favorite = F.when(F.col("favorite.is_set"), F.col("favorite.value")).otherwise(F.col("is_favorite"))
    new = {
        "last_opened_at": written("opened", "last_opened_at"),
        "is_favorite": favorite != F.coalesce(F.col("favorite.odd"), F.lit(False)),
        "display_name": written("renamed", "display_name"),
        "collection_id": written("moved", "collection_id"),
    }
    joined = _clear_collections(library, gone, small).join(document_changes(lives, commands, small), "doc_id", "left")
    return joined.where(~F.coalesce("deleted", F.lit(False))).select(
        *[new[c].alias(c) if c in new else F.col(c) for c in library.columns]
    )


def _clear_collections(library: DataFrame, gone: DataFrame, small: bool | None = None) -> DataFrame:
    joined = dimension_join(library, gone, ["owner_id", "collection_id"], ["doc_id"], small=small)
    kept = F.when(F.col("__gone"), F.lit(None)).otherwise(F.col("collection_id"))
    return joined.select(*[kept.cast("bigint").alias(c) if c == "collection_id" else F.col(c) for c in library.columns])


def mark_opened(library: DataFrame, commands: DataFrame) -> DataFrame:
    return _apply_one(library, commands, "mark_opened", "last_opened_at", F.col("ts"))


def set_favorite(library: DataFrame, commands: DataFrame) -> DataFrame:
    return _apply_one(library, commands, "set_favorite", "is_favorite", F.col("bool_value"))


def rename(library: DataFrame, commands: DataFrame) -> DataFrame:
    return _apply_one(library, commands, "rename", "display_name", F.col("str_value"))


def move(library: DataFrame, collections: DataFrame, commands: DataFrame) -> DataFrame:
    """Set the collection; a null target is the root and counts as a write.

    The rule is that of the whole fold: a move into a collection that does not exist then does nothing.
    """
    places = last_places(collection_lives(collections, commands), commands)
    written = F.when(F.col("moved_seq").isNotNull(), F.col("moved")).otherwise(F.col("collection_id"))
    return library.join(places, "doc_id", "left").select(
        *[written.alias(c) if c == "collection_id" else F.col(c) for c in library.columns]
    )


def _apply_one(library: DataFrame, commands: DataFrame, op: str, field: str, value) -> DataFrame:
    last = commands.where(_only(op)).groupBy("doc_id").agg(
        F.max("seq").alias("__seq"), F.max_by(value, F.col("seq")).alias("__last")
    )
    written = F.when(F.col("__seq").isNotNull(), F.col("__last")).otherwise(F.col(field))
    return library.join(last, "doc_id", "left").select(
        *[written.alias(c) if c == field else F.col(c) for c in library.columns]
    )


def toggle_favorite(library: DataFrame, commands: DataFrame) -> DataFrame:
    """Flip the flag once per toggle; an even number of toggles changes nothing."""
    flips = commands.where(_only("toggle_favorite")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("__flips"))
    flipped = F.col("is_favorite") != (F.coalesce(F.col("__flips"), F.lit(0)) % 2 == 1)
    return library.join(flips, "doc_id", "left").select(
        *[flipped.alias(c) if c == "is_favorite" else F.col(c) for c in library.columns]
    )


def delete_documents(library: DataFrame, commands: DataFrame) -> DataFrame:
    return library.join(commands.where(_only("delete")).select("doc_id").distinct(), "doc_id", "left_anti")


def create_collections(collections: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Append collections for ``(owner_id, seq, name)`` rows; names may repeat."""
    last = collections.agg(F.coalesce(F.max("collection_id"), F.lit(0)).alias("m")).scalar()
    rows = with_global_index(requests.select("owner_id", "seq", "name"), ["seq", "owner_id"], "__rank")
    return collections.unionByName(rows.select(
        "owner_id",
        (last + F.col("__rank") + 1).cast("bigint").alias("collection_id"),
        "name",
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
    ))


def rename_collections(collections: DataFrame, commands: DataFrame) -> DataFrame:
    keys = ["owner_id", "collection_id"]
    last = commands.where(_only("rename_collection")).groupBy(*keys).agg(
        F.max_by("str_value", "seq").alias("__name")
    )
    return collections.join(last, keys, "left").select(
        *[F.coalesce("__name", "name").alias(c) if c == "name" else F.col(c) for c in collections.columns]
    )


def delete_collections(library: DataFrame, collections: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove collections; their documents go to the root and none is deleted."""
    keys = ["owner_id", "collection_id"]
    gone = deleted.select(*keys).distinct()
    return (
        _clear_collections(library, gone.withColumn("__gone", F.lit(True))),
        collections.join(gone, keys, "left_anti"),
    )
