"""Streaming operators run to completion over the sample tables."""

from pyspark.sql import functions as F

from shelfmark.catalog.library_queries import FLAT
from shelfmark.catalog.library_queries import SQL as LIBRARY_SQL
from shelfmark.catalog.sql import FILES, with_
from shelfmark.session import shared_path
from shelfmark.sources import sample_tables as s
from shelfmark.sources.snapshots import publish_audited, read_published
from shelfmark.streaming.activity import last_opened_stream, pair_operations
from shelfmark.streaming.commands import PARTS, command_stream
from shelfmark.streaming.intake import intake_stream, read_intake

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def _stream(spark, sf_dir, name):
    schema = s.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _finish(stream_query):
    stream_query.awaitTermination()


def _collect_batches(spark, stream, mode):
    """Write every batch to a folder of its own; a retried batch replaces itself."""
    target = shared_path(spark, "batches")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    _finish(
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", shared_path(spark, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    return spark.read.option("basePath", target).schema(stream.schema).parquet(target)


@query("last_opened_stream", """
SELECT user_id AS doc_id, max(ts) AS last_opened_at FROM events WHERE event_type = 'view' GROUP BY 1""")
def _(spark, d):
    log = _stream(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "ts",
        F.when(F.col("event_type") == "view", "mark_opened").otherwise("other").alias("op"))
    updates = _collect_batches(spark, last_opened_stream(log), "update")
    return updates.groupBy("doc_id").agg(F.max("last_opened_at").cast("timestamp_ntz").alias("last_opened_at"))


@query("intake_stream", with_(FILES) + """
SELECT path, CASE WHEN NOT good THEN 'document_corrupt' END AS failure_code,
       CASE WHEN good THEN sha256(body) END AS content_hash, strlen(body)::BIGINT AS size_bytes FROM files""")
def _(spark, d):
    return _intake(spark, d).select("path", "failure_code", "content_hash", "size_bytes")


def _intake(spark, d):
    """The files arrive in three batches, each in the files Spark writes for it."""
    landing, target, checkpoint = (shared_path(spark, n) for n in ("landing", "intake", "checkpoint"))
    files = s.files(spark, d)
    for turn in range(3):
        files.where(F.pmod(F.xxhash64("path"), F.lit(3)) == turn).write.mode("append").parquet(landing)
        arriving = spark.readStream.schema("path string, length long, content binary").parquet(landing)
        _finish(intake_stream(arriving, target, checkpoint))
    return read_intake(spark, target)


@query("intake_first_copies", with_(FILES) + """
SELECT sha256(body) AS content_hash, count(*) AS files, 1::BIGINT AS first_copies FROM files WHERE good GROUP BY 1""")
def _(spark, d):
    return _intake(spark, d).where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("seen_before")).alias("first_copies"))


@query("command_stream", LIBRARY_SQL["apply_commands"])
def _(spark, d):
    library, collections = shared_path(spark, "library"), shared_path(spark, "collections")
    publish_audited(spark, lambda: s.library(spark, d), library, key="doc_id", parts=PARTS)
    publish_audited(spark, lambda: s.collections(spark, d), collections)
    # The log arrives in three batches, in the order of seq; each run of the stream folds what has arrived.
    log, checkpoint, whole = shared_path(spark, "log"), shared_path(spark, "checkpoint"), shared_path(spark, "commands")
    s.commands(spark, d).write.parquet(whole)
    commands = spark.read.parquet(whole)
    last = commands.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    cuts = [None, last // 3, 2 * last // 3, None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        after = F.lit(True) if low is None else F.col("seq") > low
        upto = F.lit(True) if high is None else F.col("seq") <= high
        commands.where(after & upto).write.mode("append").parquet(log)
        arriving = spark.readStream.schema(commands.schema).parquet(log)
        _finish(command_stream(arriving, library, collections, checkpoint))
    return read_published(spark, library).select(*FLAT)


# The watermark is the smaller of the two newest times less the delay. A start without an end comes out
# once the watermark has passed its bound; later ones are still in the state.
@query("pair_operations", """
WITH starts AS (SELECT event_id::VARCHAR AS op_id, event_type AS op, strlen(props)::BIGINT AS bytes, ts AS started_at FROM events),
ends AS (SELECT event_id::VARCHAR AS op_id, 'success' AS result, round(value)::BIGINT AS ms,
  ts + to_microseconds(round(value * 1000000)::BIGINT) AS ended_at FROM events WHERE event_type <> 'error'),
mark AS (SELECT least((SELECT max(started_at) FROM starts), (SELECT max(ended_at) FROM ends)) - INTERVAL 10 MINUTE AS w)
SELECT s.op_id, s.op, s.bytes, e.result, e.ms FROM starts s LEFT JOIN ends e
  ON e.op_id = s.op_id AND e.ended_at BETWEEN s.started_at AND s.started_at + INTERVAL 10 MINUTE
WHERE e.op_id IS NOT NULL OR s.started_at + INTERVAL 10 MINUTE < (SELECT w FROM mark)""")
def _(spark, d):
    events = _stream(spark, d, "events")
    starts = events.select(
        F.col("event_id").cast("string").alias("op_id"), F.col("event_type").alias("op"),
        F.lit(None).cast("string").alias("file_hash"), F.octet_length("props").cast("bigint").alias("bytes"),
        F.col("ts").cast("timestamp").alias("ts"))
    took = F.make_dt_interval(secs=F.col("value"))
    ends = _stream(spark, d, "events").where(F.col("event_type") != "error").select(
        F.col("event_id").cast("string").alias("op_id"), F.lit("success").alias("result"),
        F.round("value").cast("bigint").alias("ms"), F.lit(None).cast("string").alias("code"),
        F.lit(None).cast("string").alias("detail"), (F.col("ts").cast("timestamp") + took).alias("ts"))
    return _collect_batches(spark, pair_operations(starts, ends), "append").select("op_id", "op", "bytes", "result", "ms")
