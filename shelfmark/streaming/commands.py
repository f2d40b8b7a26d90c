"""The command fold as a stream of micro-batches over published snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.commands import COLLECTION_OPS, apply_commands, apply_to_collections
from shelfmark.plans.skew import measured_small
from shelfmark.sources.snapshots import (
    current_tag, part_count, part_of, publish_audited, publish_parts, read_published)

PARTS = 64


def touched_parts(library: DataFrame, log: DataFrame, parts: int) -> list[int]:
    """Numbers of the parts that hold a document the log names or a document of a collection it deletes."""
    named = log.where(F.col("doc_id").isNotNull()).select(part_of("doc_id", parts).alias("part"))
    keys = ["owner_id", "collection_id"]
    gone = log.where(F.col("op") == "delete_collection").select(*keys).distinct()
    if not gone.isEmpty():
        held = library.select("doc_id", *keys).join(F.broadcast(gone) if measured_small(gone) else gone, keys, "left_semi")
        named = named.union(held.select(part_of("doc_id", parts)))
    return sorted(r[0] for r in named.distinct().collect())


def _publish_library(spark: SparkSession, target: str, collections: DataFrame, log: DataFrame, tag: dict, parts: int) -> None:
    """A table that is not cut yet is cut now; afterwards only touched parts are read and written."""
    cut = part_count(spark, target)
    library = read_published(spark, target)
    if cut is None:
        publish_audited(spark, lambda: apply_commands(library, collections, log).select(*library.columns), target,
                        tag=tag, allow_empty=True, key="doc_id", parts=parts)
        return
    touched = touched_parts(library, log, cut)
    changed = None
    if touched:
        changed = apply_commands(read_published(spark, target, parts=touched), collections, log)
    publish_parts(spark, changed, touched, target, "doc_id", tag)


def command_stream(
    commands: DataFrame, library_target: str, collections_target: str, checkpoint: str, available_now: bool = True,
    parts: int = PARTS,
) -> StreamingQuery:
    """Fold each batch into the published library and collections.

    The library is cut into parts by document, and a batch reads and writes only the parts that hold documents it
    names or documents of collections it deletes (found by a scan of three columns); all other
    parts are taken over as they are. A library published in one piece is cut by its first batch.

    Both snapshots store the last batch id and the largest ``seq`` they have folded. A repeated batch is
    skipped where it was already published. A command that comes after a later one was folded cannot be
    put in its place any more: it changes nothing and is kept below ``_late`` of the library's folder, so
    the result equals one fold of all other commands. Collections are published last: a batch that
    failed in between still finds the collections it started from.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            newest = batch.agg(F.max("seq")).first()[0]

            def turn(target: str) -> tuple[DataFrame, DataFrame, dict] | None:
                """The commands that are not late, those that are, and the tag to publish; nothing when the batch is there already."""
                done = current_tag(spark, target) or {"batch": -1, "seq": None}
                if done["batch"] >= batch_id:
                    return None
                seq = done["seq"]
                seen = [x for x in (seq, newest) if x is not None]
                at = F.col("seq")
                on_time = batch if seq is None else batch.where(at > seq)
                late = batch.where(at.isNull() if seq is None else at.isNull() | (at <= seq))
                return on_time, late, {"batch": batch_id, "seq": max(seen, default=None)}

            collections = read_published(spark, collections_target)
            if todo := turn(library_target):
                on_time, late, tag = todo
                if not late.isEmpty():
                    late.write.mode("overwrite").parquet(f"{library_target.rstrip('/')}/_late/batch_id={batch_id}")
                _publish_library(spark, library_target, collections, on_time, tag, parts)
            if todo := turn(collections_target):
                on_time, _, tag = todo
                log = on_time.where(F.col("op").isin(*COLLECTION_OPS))
                publish_audited(spark, lambda: apply_to_collections(collections, log), collections_target, allow_empty=True, tag=tag)
        finally:
            batch.unpersist()

    writer = commands.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
