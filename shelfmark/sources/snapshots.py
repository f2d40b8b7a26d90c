"""Write, audit, publish: versions of a table that become visible in one step.

Layout below a target folder::

    data-<uuid>/             Parquet files that one publication wrote
    _versions/version=<n>/   a small marker, written by Spark once the data passed its check

A marker names the folders a version consists of, its schema and a tag. Readers follow the highest marker, so data
without one is invisible. A table may be cut into parts by a key; a publication then writes only
the parts it changes and names the folders of the others again. A target has one writer at a time,
such as one streaming query; earlier versions stay readable.
"""

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.session import remove_path

MARKER = "part int, parts int, data string, tag string, schema string"


class NothingProduced(Exception):
    """The producer gave no data."""


class ValidationRejected(Exception):
    """The validator refused the written data."""


def _versions(target: str) -> str:
    return f"{target.rstrip('/')}/_versions"


def current_version(spark: SparkSession, target: str) -> int | None:
    try:
        return spark.read.schema(f"{MARKER}, version int").parquet(_versions(target)).agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _marker(spark: SparkSession, target: str, version: int) -> list:
    """One row, or one for each part; the number of parts is fixed when the table is first cut."""
    return spark.read.schema(MARKER).parquet(f"{_versions(target)}/version={version}").collect()


def current_tag(spark: SparkSession, target: str):
    """Tag stored with the current version, such as the last batch id."""
    version = current_version(spark, target)
    return None if version is None else json.loads(_marker(spark, target, version)[0].tag)


def part_count(spark: SparkSession, target: str) -> int | None:
    """The number of parts of the current version; null for a table that is not cut."""
    return _marker(spark, target, current_version(spark, target))[0].parts


def part_of(key: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def read_published(
    spark: SparkSession, target: str, version: int | None = None, parts: Iterable[int] | None = None
) -> DataFrame:
    """The current version, or an older one by number; with ``parts`` only those parts are read."""
    version = current_version(spark, target) if version is None else version
    if version is None:
        raise FileNotFoundError(f"nothing published at {target}")
    rows = _marker(spark, target, version)
    wanted = None if parts is None else set(parts)
    schema = StructType.fromJson(json.loads(rows[0].schema))
    folders = [f"{target.rstrip('/')}/{r.data}" for r in rows if r.data and (wanted is None or r.part in wanted)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _mark(spark: SparkSession, target: str, version: int, rows: list[tuple], schema: StructType, tag) -> int:
    """One file, so the version appears at once; what a lost writer left of the same marker is replaced."""
    body = [(part, parts, data, json.dumps(tag), schema.json()) for part, parts, data in rows]
    spark.createDataFrame(body, MARKER).coalesce(1).write.mode("overwrite").parquet(f"{_versions(target)}/version={version}")
    return version


def _next(spark: SparkSession, target: str) -> int:
    base = current_version(spark, target)
    return 0 if base is None else base + 1


def publish_audited(
    spark: SparkSession,
    produce: Callable[[], DataFrame | None],
    target: str,
    validate: Callable[[DataFrame], bool] | None = None,
    tag=None,
    allow_empty: bool = False,
    key: str | None = None,
    parts: int | None = None,
    lookup: str | None = None,
) -> int:
    """Write what ``produce`` gives, check it, then make it the current version.

    If writing or checking fails, the written data is removed, the version before stays current and
    the original error is raised. With ``key`` and ``parts`` the table is cut into parts by the key's hash.
    With ``lookup`` the files are sorted by that column and hold bloom filters of it, so a search for one value opens
    only the row groups that may hold it.
    """
    data = f"data-{uuid.uuid4().hex}"
    staged = f"{target.rstrip('/')}/{data}"
    try:
        produced = produce()
        if produced is None:
            raise NothingProduced("producer gave no data")
        written = _write(produced, staged, key, parts, lookup)
        if not allow_empty and written.isEmpty():
            raise NothingProduced("producer wrote no rows")
        if validate is not None and not validate(written):
            raise ValidationRejected("validation rejected the output")
        rows = [(None, None, data)] if parts is None else _cut(spark, staged, data, parts)
    except BaseException:
        remove_path(spark, staged)
        raise
    return _mark(spark, target, _next(spark, target), rows, produced.schema, tag)


def _write(df: DataFrame, staged: str, key: str | None, parts: int | None, lookup: str | None = None) -> DataFrame:
    # A part's rows meet before they are written, so it is one file, or a few when it is large, and not one for each task.
    rows = df if parts is None else df.withColumn("__part", part_of(key, parts)).hint("rebalance", "__part")
    if lookup is not None:
        rows = rows.repartitionByRange(lookup) if parts is None else rows
        rows = rows.sortWithinPartitions(*([] if parts is None else ["__part"]), lookup)
    writer = rows.write.mode("error")
    if lookup is not None:
        # Parquet leaves the filter out where a dictionary holds all values; for a column of distinct ids that is no gain.
        writer = writer.option(f"parquet.bloom.filter.enabled#{lookup}", "true").option(
            f"parquet.enable.dictionary#{lookup}", "false")
    (writer if parts is None else writer.partitionBy("__part")).parquet(staged)
    return df.sparkSession.read.schema(df.schema).parquet(staged)


def _cut(spark: SparkSession, staged: str, data: str, parts: int) -> list[tuple]:
    """A marker row for each part that has rows; one without a folder when none has."""
    held = spark.read.schema("__part int").parquet(staged).select("__part").distinct().collect()
    return [(r[0], parts, f"{data}/__part={r[0]}") for r in held] or [(None, parts, None)]


def publish_parts(spark: SparkSession, changed: DataFrame | None, touched: Iterable[int], target: str, key: str, tag=None) -> int:
    """Publish a version whose parts ``touched`` hold the rows of ``changed`` and whose other parts stay as they are.

    Only the touched parts are written; none when ``changed`` is null, which moves the tag alone.
    """
    version = current_version(spark, target)
    rows = _marker(spark, target, version)
    schema, parts, touched = StructType.fromJson(json.loads(rows[0].schema)), rows[0].parts, set(touched)
    kept = [(r.part, parts, r.data) for r in rows if r.data and (changed is None or r.part not in touched)]
    fresh = []
    if changed is not None:
        data = f"data-{uuid.uuid4().hex}"
        staged = f"{target.rstrip('/')}/{data}"
        try:
            _write(changed.select(*schema.names), staged, key, parts)
            fresh = [r for r in _cut(spark, staged, data, parts) if r[2]]
        except BaseException:
            remove_path(spark, staged)
            raise
    return _mark(spark, target, version + 1, kept + fresh or [(None, parts, None)], schema, tag)
