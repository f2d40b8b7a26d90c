"""Joins against a lookup table when a few keys may hold a large share of the rows."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
TASK_ROWS = 1_000_000
HOT_SHARE = 20_000
NULL_SLOTS = 1 << 20

_SALT = "__salt"
_SLOTS = "__slots"


def measured_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Count rows and bytes of ``df``; true when both are inside the broadcast bound."""
    rows, size = df.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)),
    ).first()
    return rows <= max_rows and size <= max_bytes


def hot_keys(df: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Keys with more than ``task_rows`` rows and the number of tasks each should get.

    Counting combines on the map side. A key must also hold more than one row in ``HOT_SHARE``, so at most
    that many keys can be hot however large the table is; no list is cut.
    """
    counted = (
        df.select(*keys)
        .where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__rows"))
    )
    total = df.agg(F.count(F.lit(1)).alias("__total")).scalar()
    return counted.where(F.col("__rows") > F.greatest(F.lit(task_rows), total / HOT_SHARE)).select(
        *keys, F.ceil(F.col("__rows") / F.lit(task_rows)).cast("int").alias(_SLOTS))


def salted_lookup(
    probe: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "left",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Join ``probe`` to ``lookup`` on ``keys`` with each hot probe key split over several tasks.

    The number of splits follows the key's row count, and only lookup rows of hot keys are
    copied, once per split. ``spread`` names probe columns that differ between the rows of
    one key, so a row gets the same salt on every task attempt. Rows with a null key can
    match nothing; they are spread too instead of meeting in one task.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(probe, keys, task_rows))
    row = F.xxhash64(*spread)
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = (
        F.when(null_key, F.pmod(row, F.lit(NULL_SLOTS)))
        .when(F.col(_SLOTS).isNotNull(), F.pmod(row, F.col(_SLOTS)))
        .otherwise(F.lit(0))
    )
    left = probe.join(hot, keys, "left").withColumn(_SALT, salt.cast("int")).drop(_SLOTS)
    copies = F.sequence(F.lit(0), F.coalesce(F.col(_SLOTS), F.lit(1)) - 1)
    right = lookup.join(hot, keys, "left").withColumn(_SALT, F.explode(copies)).drop(_SLOTS)
    return left.join(right, [*keys, _SALT], how).drop(_SALT)


def split_lookup(
    probe: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Join a narrow ``probe`` to a ``lookup`` unique on ``keys`` without shuffling hot rows.

    Rows of hot keys meet a broadcast of their few lookup rows where they are read, so an
    aggregation that follows can combine them before its shuffle. Only the other rows are
    shuffled. The probe is read once more than in ``salted_lookup``, so this is for tables
    that are cheap to read.
    """
    keys = list(keys)
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hot = hot_keys(probe, keys, task_rows).select(*keys)
    direct = probe.join(F.broadcast(hot.join(lookup, keys, how)), keys)
    rest = probe.where(has_key).join(F.broadcast(hot), keys, "left_anti").join(lookup, keys, how)
    out = direct.unionByName(rest)
    return out.unionByName(probe.where(~has_key), allowMissingColumns=True) if how == "left" else out


def dimension_join(
    probe: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "left",
    small: bool | None = None,
) -> DataFrame:
    """Broadcast ``dimension`` when its measured size allows it, else salt hot keys.

    ``small`` passes on the outcome of an earlier ``measured_small``.
    """
    if measured_small(dimension) if small is None else small:
        return probe.join(F.broadcast(dimension), list(keys), how)
    return salted_lookup(probe, dimension, keys, spread, how)


def few_against_many(
    few: DataFrame, many: DataFrame, keys: Sequence[str], spread: Sequence[str | Column]
) -> DataFrame:
    """Inner join of a usually short request list with a large table unique on ``keys``.

    A list of measured size is broadcast and the table is not shuffled; a long list
    probes the table with its hot keys split.
    """
    if measured_small(few):
        return many.join(F.broadcast(few), list(keys))
    return salted_lookup(few, many, keys, spread, "inner")
