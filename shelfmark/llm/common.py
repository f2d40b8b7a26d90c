"""Helpers shared by the operators of this package."""

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import shared_path

SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps read the files, so a lost executor costs no recomputation and the order and
    salts of the rows are fixed.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send texts to Python in batches of ``rows``, unless the session names a size of its own.

    A batch lies in the memory of the executor's JVM and of its worker at once; the default of ten thousand whole
    texts takes tens of megabytes in each of them, and tables with long texts more.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(name: str = "text") -> Column:
    """The whole text as UTF-8; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def split_remainder(doc_id, modulus: int) -> int:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder(column: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = [0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()]
        start = size = 0
        for row, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def running_total(df: DataFrame, order: list, value: str, name: str, label: str) -> DataFrame:
    """Append the sum of ``value`` over all rows before this one in the total order ``order``.

    Rows are range-partitioned and stored, summed inside each partition, and moved by the sums
    of the partitions before; the only window over everything has one row per partition.
    """
    placed = stored(
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), label
    )
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = placed.groupBy("__part").agg(F.sum(value).alias("__sum")).select(
        "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base")
    )
    return (
        placed.withColumn("__run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(bases), "__part")
        .withColumn(name, F.col("__run") + F.col("__base"))
        .drop("__part", "__run", "__base")
    )
