"""Operation records that never carry document content."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.documents import identity_hash
from shelfmark.plans.ranking import with_running_count
from shelfmark.schemas import OPLOG

LOG_FIELDS = ["op_id", "phase", "op", "file_hash", "bytes", "result", "ms", "code", "detail", "ts"]


def redact_for_log(records: DataFrame, path: str = "path") -> DataFrame:
    """Closed projection: the path leaves only as a hash, unknown columns never leave."""
    have = set(records.columns)
    columns = []
    for name in LOG_FIELDS:
        if name == "file_hash":
            columns.append((identity_hash(F.col(path)) if path in have else F.lit(None).cast("string")).alias(name))
        elif name in have:
            columns.append(F.col(name))
        else:
            columns.append(F.lit(None).cast(OPLOG[name].dataType).alias(name))
    return records.select(*columns)


def compose_log_line(records: DataFrame) -> DataFrame:
    """Append ``line``; absent fields are left out and ``detail`` comes last."""
    def pair(key, column):
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{key}="), F.col(column).cast("string")))

    start = F.col("phase") == "start"
    line = F.concat_ws(
        " ",
        F.concat("phase", F.lit(" op="), "op"),
        F.when(start, pair("file", "file_hash")),
        F.when(start, pair("bytes", "bytes")),
        F.when(~start, pair("result", "result")),
        F.when(~start, pair("ms", "ms")),
        F.when(~start, pair("code", "code")),
        F.when(~start, pair("detail", "detail")),
    )
    return records.withColumn("line", line)


def parse_log_line(lines: DataFrame) -> DataFrame:
    """Fields of ``line``; ``detail`` takes the rest of the line, spaces and ``=`` included."""
    head = F.regexp_replace("line", r"(?s) detail=.*$", "")

    def field(key):
        value = F.regexp_extract(head, rf" {key}=(\S*)", 1)
        return F.when(value != "", value)

    detail = F.regexp_extract("line", r"(?s)^.*? detail=(.*)$", 1)
    has_detail = F.contains("line", F.lit(" detail="))
    return lines.select(
        "*",
        F.regexp_extract("line", r"^(\S+) op=", 1).alias("phase"),
        field("op").alias("op"),
        field("file").alias("file_hash"),
        field("bytes").cast("bigint").alias("bytes"),
        field("result").alias("result"),
        field("ms").cast("bigint").alias("ms"),
        field("code").alias("code"),
        F.when(has_detail, detail).alias("detail"),
    )


def operation_report(records: DataFrame) -> DataFrame:
    """Runs, outcomes and timing per operation.

    Equal timings are counted first. The exact percentiles are read off the running counts of the range-partitioned
    timings, so an operation with any number of distinct timings is spread over tasks.
    """
    ended = records.where(F.col("phase") == "end")
    success = F.col("result") == "success"
    histogram = ended.groupBy("op", "ms").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(success).alias("ok"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )
    weight = F.col("n")
    timed = F.when(F.col("ms").isNotNull(), weight).otherwise(0)
    counted = with_running_count(histogram, ["op"], ["ms"], timed, "upto")

    def at(position):
        """The timing at a position (from 0) of all timings in order."""
        here = (F.col("upto") - timed <= position) & (position < F.col("upto"))
        return F.max(F.when(here, F.col("ms")))

    def percentile(p):
        position = (F.max("upto_total") - 1) * p
        place = (F.col("upto_total") - 1) * F.lit(p)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return F.round(low + (high - low) * (position - F.floor(position)), 6)

    return counted.groupBy("op").agg(
        F.sum("n").alias("runs"),
        F.sum("ok").alias("successes"),
        F.sum(weight - F.col("ok")).alias("failures"),
        F.min("ms").alias("min_ms"),
        F.round(F.sum(F.col("ms") * weight) / F.sum(F.when(F.col("ms").isNotNull(), weight)), 6).alias("avg_ms"),
        percentile(0.5).alias("p50_ms"),
        percentile(0.95).alias("p95_ms"),
        F.max("ms").alias("max_ms"),
        F.sum("bytes").alias("bytes"),
    )


def failures_by_code(records: DataFrame) -> DataFrame:
    failed = records.where((F.col("phase") == "end") & (F.col("result") == "failure"))
    return failed.groupBy("op", "code").agg(F.count(F.lit(1)).alias("failures"))
