"""Exact duplicates by deterministic block naming (Karp, Miller and Rosenberg 1972)."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.plans.skew import dimension_join, salted_lookup

BLOCK_BYTES = 4096
TASK_ROWS = 100_000
BLANK_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text as UTF-8 with each run of blanks replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ").cast("binary")


def cut_blocks(docs: DataFrame, size: int, digest: Column) -> DataFrame:
    """(row, doc_id, sha, pos, n, digest, block): the ``n`` blocks of ``size`` bytes of each text; an empty one has one.

    ``doc_id`` and ``sha`` stand at a row's first block only. ``row`` holds for one reading of the table.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), normalised(F.col("text")).alias("bytes"))
    last = F.floor((F.greatest(F.length("bytes"), F.lit(1)) - 1) / size).cast("int")
    # Positions are exploded before blocks are cut, so a text is normalised once and not once for each block.
    placed = texts.select("row", "doc_id", "bytes", last.alias("last")).select(
        "row", "doc_id", "bytes", (F.col("last") + 1).alias("n"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("pos"))
    first = F.col("pos") == 0
    return placed.select(
        "row", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.sha2("bytes", 256)).alias("sha"), "pos", "n",
        F.substring("bytes", F.col("pos") * size + 1, F.lit(size)).alias("block"),
    ).withColumn("digest", digest)


def sorted_names(values: DataFrame, order: list[str]) -> DataFrame:
    """``values`` (distinct rows) with ``name``, an integer that grows in the order of ``order``.

    The values are range-partitioned and sorted; the numbers are written with them, so they are fixed.
    """
    placed = values.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("name", F.monotonically_increasing_id()), "names")


def named_blocks(docs: DataFrame, size: int, digest: Column) -> DataFrame:
    """(row, doc_id, sha, pos, n, name) of every block: equal names exactly for equal blocks.

    Blocks are combined on the map side and cross the network once, for the distinct ones, which shows the
    digests that different blocks share. Any other digest stands for its one block from then on; a block
    with a shared digest keeps its bytes. Digests and such blocks are sorted into names.
    """
    distinct = cut_blocks(docs, size, digest).select("digest", "block").distinct()
    shared = stored(distinct.groupBy("digest").count().where("count > 1").select("digest", F.lit(True).alias("shared")), "shared")
    blocks = cut_blocks(docs, size, digest)
    if shared.isEmpty():
        places = blocks.withColumn("block", F.lit(b""))
    else:
        places = dimension_join(blocks, shared, ["digest"], ["row", "pos"]).withColumn(
            "block", F.when(F.col("shared"), F.col("block")).otherwise(F.lit(b"")))
    places = stored(places.select("row", "doc_id", "sha", "pos", "n", "digest", "block"), "places")
    keys = ["digest", "block"]
    names = sorted_names(places.select(*keys).distinct(), keys)
    return salted_lookup(places, names, keys, ["row", "pos"], "inner", TASK_ROWS).drop(*keys)


def identities(docs: DataFrame, size: int = BLOCK_BYTES, digest: Column | None = None) -> DataFrame:
    """(row, doc_id, sha, level, name): rows share (level, name) exactly when their normalised texts are equal.

    Sorted blocks get integer names. Then the adjacent names of a row form pairs, the distinct pairs are sorted into
    the names of the next level, and so on until a row has one name left; a last name without a
    partner is paired with none. A level has half the rows of the one before, so there are as many as the
    logarithm of the longest text. ``digest`` of the column ``block`` deals blocks to tasks; one that lets
    different blocks meet costs time and changes no identity.
    """
    now = stored(named_blocks(docs, size, F.md5("block") if digest is None else digest), "level")
    rows = now.where("pos = 0").select("row", "doc_id", "sha")
    done, level = [], 0
    while True:
        done.append(now.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        longer = now.where("n > 1")
        if longer.isEmpty():
            break
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        even = F.col("pos") % 2 == 0
        pairs = stored(longer.groupBy("row", half, F.ceil(F.col("n") / 2).cast("int").alias("n")).agg(
            F.max(F.when(even, F.col("name"))).alias("one"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("two")), "pairs")
        names = sorted_names(pairs.select("one", "two").distinct(), ["one", "two"])
        now = stored(salted_lookup(pairs, names, ["one", "two"], ["row", "pos"], "inner", TASK_ROWS).select(
            "row", "pos", "n", "name"), "level")
        level += 1
    return reduce(DataFrame.union, done).join(rows, "row")


def exact_groups(docs: DataFrame, size: int = BLOCK_BYTES, digest: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per row of ``docs``.

    Texts are equal when they are identical after each run of blanks became one space; null counts as empty, and
    blanks at the ends count. Of each group the row with the smallest doc_id stays (``keep_id``). Rows
    repeated under one id are rows of the group and exactly one of them stays; a row without an id
    comes after all ids and stays only where the group has none. No rows give no rows; columns besides doc_id
    and text are not read.
    """
    ids = stored(identities(docs, size, digest), "identities")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = ids.groupBy("level", "name").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("group_size"))
    placed = salted_lookup(ids, groups, ["level", "name"], ["row"], "inner", TASK_ROWS)
    return placed.select(
        "doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("least.row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x)::BIGINT AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
