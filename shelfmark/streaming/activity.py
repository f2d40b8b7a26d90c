"""Last opened times and paired operation records on event time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def last_opened_stream(commands: DataFrame, delay: str = "1 day", span: str = "1 day") -> DataFrame:
    """Running latest open per document; write it in update mode and keep the largest time of a document.

    The state holds one row per document and ``span`` of time, and lets it go once the watermark has passed the
    span, so it is as large as the documents opened lately. A command delivered again changes no maximum and needs no state of
    its own. Opens behind the watermark are left out; ``LateRecords`` counts them.
    """
    opened = commands.where(F.col("op") == "mark_opened").select("doc_id", F.col("ts").cast("timestamp").alias("at"))
    return (
        opened.withWatermark("at", delay)
        .groupBy(F.window("at", span), "doc_id")
        .agg(F.max("at").alias("last_opened_at"))
        .select("doc_id", "last_opened_at")
    )


def pair_operations(starts: DataFrame, ends: DataFrame, bound: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Join start and end records of one ``op_id`` that lie within ``bound``.

    A start without an end inside the bound comes out with a null ``result`` once the
    watermark has passed it, which also lets the state go. Records behind the watermark are left out;
    ``LateRecords`` counts them.
    """
    s = starts.select(
        "op_id", "op", "file_hash", "bytes", F.col("ts").alias("started_at")
    ).withWatermark("started_at", delay)
    e = ends.select(
        F.col("op_id").alias("end_id"), "result", "ms", "code", "detail", F.col("ts").alias("ended_at")
    ).withWatermark("ended_at", delay)
    near = (
        (F.col("op_id") == F.col("end_id"))
        & (F.col("ended_at") >= F.col("started_at"))
        & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {bound}"))
    )
    return s.join(e, near, "leftOuter").drop("end_id")


LATE = "query string, batch_id long, late_records long"


class LateRecords(StreamingQueryListener):
    """Counts the records that stateful operators left out because they came behind the watermark.

    Register it with ``spark.streams.addListener`` before the query starts. Each batch with late records gets a row below
    ``target``; a batch that is reported again replaces its row.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        if late:
            row = self.spark.createDataFrame([(str(progress.id), progress.batchId, late)], LATE)
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.target}/{progress.id}-{progress.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_late_records(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(LATE).option("recursiveFileLookup", "true").parquet(target)
