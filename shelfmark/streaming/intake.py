"""Files landing in a folder, taken in once each."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.intake import classify_intake, content_address
from shelfmark.plans.skew import dimension_join, measured_small
from shelfmark.schemas import FILES


def read_landing(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[pP][dD][fF]")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def intake_batch(files: DataFrame) -> DataFrame:
    """Codes and addresses of one batch; rejected files keep their row without an address."""
    checked = content_address(classify_intake(files))
    accepted = F.col("failure_code").isNull()
    return checked.select(
        "path", "failure_code", "failure_detail", "size_bytes",
        F.when(accepted, F.col("content_hash")).alias("content_hash"),
        F.when(accepted, F.col("relative_path")).alias("relative_path"),
    )


PREFIXES = 256


def _hashes(target: str) -> str:
    return f"{target.rstrip('/')}/_hashes"


def _prefix():
    """The first byte of a content hash."""
    return F.conv(F.substring("content_hash", 1, 2), 16, 10).cast("int")


def known_hashes(hashes: DataFrame, target: str, before: int) -> DataFrame:
    """Hashes first seen in batches before ``before`` that share a prefix with one of ``hashes``.

    At most ``PREFIXES`` numbers come to the driver; the scan opens only the folders of these prefixes.
    """
    spark = hashes.sparkSession
    prefixes = [r[0] for r in hashes.select(_prefix()).distinct().limit(PREFIXES).collect()]
    stored = spark.read.schema("content_hash string, batch_id long, prefix int").option("basePath", _hashes(target)).parquet(_hashes(target))
    return stored.where(F.col("prefix").isin(prefixes) & (F.col("batch_id") < before)).select("content_hash")


def intake_stream(files: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append intake rows below ``target``; all but the first row of equal content are flagged.

    A batch writes to a folder of its own and overwrites it when retried, so a repeated
    batch leaves no second copy, and it compares itself only with earlier batches. Of these it reads no rows
    but the hashes first seen there, and of those only the prefixes that its own hashes have.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The addressed rows are small; keeping them avoids reading the bytes again.
        rows = intake_batch(batch).persist()
        try:
            first = rows.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("path").alias("__first"))
            facts = first.withColumn("__known", F.lit(False))
            if batch_id > 0:
                earlier = known_hashes(first, target, batch_id)
                few = first.select("content_hash")
                known = earlier.join(F.broadcast(few) if measured_small(few) else few, "content_hash", "left_semi").distinct()
                facts = first.join(known.withColumn("__seen", F.lit(True)), "content_hash", "left").select(
                    "content_hash", "__first", F.coalesce("__seen", F.lit(False)).alias("__known"))
            fresh = facts.where(~F.col("__known")).select("content_hash", _prefix().alias("prefix"))
            fresh.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(
                f"{_hashes(target)}/batch_id={batch_id}")
            seen = F.coalesce(F.col("__known") | (F.col("path") != F.col("__first")), F.lit(False))
            out = dimension_join(rows, facts, ["content_hash"], ["path"])
            out.withColumn("seen_before", seen).drop("__known", "__first").write.mode("overwrite").parquet(
                f"{target.rstrip('/')}/batch_id={batch_id}"
            )
        finally:
            rows.unpersist()

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_intake(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(target)
