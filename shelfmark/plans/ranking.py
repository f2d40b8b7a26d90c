"""Global positions and ranks without sending a whole group to one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.plans.skew import salted_lookup
from shelfmark.session import cut_lineage

_LOW_BITS = 33


def with_global_index(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Append a dense 0-based position in the total order of ``order``."""
    return with_row_positions(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def with_row_positions(df: DataFrame, name: str) -> DataFrame:
    """Append the 0-based position of each row in the order the partitions of ``df`` hold them.

    The rows are checkpointed once, so the running number inside a partition cannot change when a task is
    retried. The only window runs over one row per partition.
    """
    placed = cut_lineage(
        df.withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftrightunsigned(F.col("__at"), _LOW_BITS))
    )
    before = W.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    local = F.col("__at").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return (
        placed.join(F.broadcast(bases), "__part")
        .withColumn(name, local + F.col("__base"))
        .drop("__at", "__part", "__base")
    )


def with_running_count(df: DataFrame, group: Sequence[str], order: Sequence[str], count: Column, name: str) -> DataFrame:
    """Append ``name``, the sum of ``count`` over the group's rows up to this one, and ``{name}_total``, that of the group.

    Rows are range-partitioned once and kept. A window holds one partition's share of a group, and one more the few sums of a
    group's partitions; null keys are a group like others.
    """
    group, order = list(group), list(order)
    ranges = df.withColumn("__count", count).repartitionByRange(*group, *order)
    placed = cut_lineage(ranges.withColumn("__part", F.spark_partition_id()))
    parts = W.partitionBy(*group).orderBy("__part")
    before, whole = (parts.rowsBetween(W.unboundedPreceding, end) for end in (-1, W.unboundedFollowing))
    bases = placed.groupBy(*group, "__part").agg(F.sum("__count").alias("__n")).select(
        F.struct(*group).alias("__group"), F.col("__part").alias("__at"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(whole).alias(f"{name}_total"))
    inside = W.partitionBy(*group, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = placed.withColumn("__run", F.sum("__count").over(inside))
    same = F.struct(*group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at"))
    return run.join(bases, same).withColumn(name, F.col("__run") + F.col("__base")).drop(
        "__count", "__part", "__at", "__group", "__run", "__base")


def with_group_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str, spread: Sequence[str]
) -> DataFrame:
    """Append the 0-based position of each row inside its group, whatever the group's size."""
    group = list(group)
    indexed = with_global_index(df, [*group, *order], "__index")
    starts = indexed.groupBy(*group).agg(F.min("__index").alias("__start"))
    return (
        salted_lookup(indexed, starts, group, spread, "inner")
        .withColumn(name, F.col("__index") - F.col("__start"))
        .drop("__index", "__start")
    )
