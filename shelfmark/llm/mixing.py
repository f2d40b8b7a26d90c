"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACED_WORD, running_total, stored
from shelfmark.plans.ranking import with_global_index
from shelfmark.plans.skew import dimension_join

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
KEY_BITS = 48
SYMBOLS = "#$%&*|"
ORDER = ["sample_key", "doc_id", "size"]


def sampling_columns() -> list[Column]:
    """source_key, size and sample_key of a document.

    The uniform number is taken from the md5 of the id, so reruns agree. The quality weight
    falls with the share of symbol characters. An exponential variable divided by the weight,
    taken in ascending order, is the weighted draw without replacement.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    quality = F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * symbols / F.greatest(F.length(text), F.lit(1)))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("double") + 1.0) / float(1 << KEY_BITS)
    return [
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("a"), "source")).alias("source_key"),
        F.regexp_count(text, F.lit(SPACED_WORD)).cast("long").alias("size"),
        (-F.log(uniform) / quality).alias("sample_key"),
    ]


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """Targets of (source_key, source_size) rows, by water filling.

    Sources in code-point order (null last) take the weights in turn. Only sums go to the
    driver; each round fixes the sources that reached their limit and shares the rest anew.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = with_global_index(sources, ["source_key"], "rank")
    ranked = stored(
        ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(limit)), "targets",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        full = F.col("limit") <= F.lit(level) * F.col("weight")
        n, used, open_weight = ranked.agg(
            F.count_if(full), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == fixed or not open_weight:
            break
        fixed, level = n, (share * total - (used or 0.0)) / open_weight
    target = F.when(F.lit(not open_weight) | full, F.col("limit")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source_key", "source_size", target.alias("target"))


def decide(
    base: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """``base`` with source_size, target, epochs and fits (whether the row is in the last, partial epoch).

    A source first gives all its documents ``epochs = floor(target / source_size)`` times; the rest of the
    target goes to its documents in the order of their keys as long as at least half of the next one
    fits, so a source misses its target by at most half a document.
    """
    sources = base.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    placed = running_total(base, ["source_key", *ORDER], "size", "words_before", "mixing")
    starts = placed.groupBy("source_key").agg(F.min("words_before").alias("source_start"))
    facts = source_targets(sources, weights, share, limit).join(starts, "source_key")
    rows = dimension_join(placed, facts, ["source_key"], ORDER, "inner")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    fits = (F.col("words_before") - F.col("source_start") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    return rows.withColumn("epochs", whole.cast("long")).withColumn("rest", rest).withColumn("fits", fits)


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """doc_id, size, source_size, target, repeats and taken, one row per row of ``docs``.

    Null text is empty (size 0, taken 0). Null sources form one source, ordered last. Rows with
    the same doc_id draw the same key and are ordered by size; rows that are equal in all of it
    are interchangeable. No rows give no rows. Other columns are not read.
    """
    base = stored(docs.select("doc_id", *sampling_columns()), "sizes")
    repeats = F.col("epochs") + F.col("fits").cast("long")
    return decide(base, weights, share, limit).select(
        "doc_id", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def mix_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """The documents the mix takes, with the column ``repeats`` (an earlier one of that name goes).

    What a source takes of its last epoch is the beginning of its key order, so its last row decides
    for every document where it is read, and texts are not shuffled.
    """
    rows = decide(stored(docs.select("doc_id", *sampling_columns()), "sizes"), weights, share, limit)
    last = rows.groupBy("source_key").agg(
        F.first("epochs").alias("__epochs"), F.max(F.when(F.col("fits"), F.struct(*ORDER))).alias("__last"))
    columns = [c for c in docs.columns if c != "repeats"]
    keyed = docs.select(*columns, F.struct("doc_id", *sampling_columns()).alias("__mix")).withColumn(
        "source_key", F.col("__mix.source_key"))
    joined = dimension_join(keyed, last, ["source_key"], ["doc_id"], "inner")
    own = F.struct(*[F.col("__mix")[c].alias(c) for c in ORDER])
    repeats = F.col("__epochs") + F.coalesce(own <= F.col("__last"), F.lit(False)).cast("long")
    return joined.select(*columns, repeats.alias("repeats")).where("repeats > 0")


SQL = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 1.0) / {float(1 << KEY_BITS)!r}::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * (length(t) - length(translate(t, '{SYMBOLS}', '')))
      / greatest(length(t), 1))) AS k FROM base),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w
  FROM keyed GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS i FROM sources),
steps AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
      - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
lvl AS (SELECT level, i AS first_open FROM steps WHERE cap > level * w ORDER BY i LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN (SELECT first_open FROM lvl) IS NULL OR i < (SELECT first_open FROM lvl) THEN cap
         ELSE (SELECT level FROM lvl) * w END AS target FROM filled),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS e FROM placed)
SELECT doc_id, size, source_size, target, r AS repeats, (r * size)::BIGINT AS taken FROM (
  SELECT *, e + (CASE WHEN target - e * source_size > 0 AND before + size / 2.0::DOUBLE <= target - e * source_size
    THEN 1 ELSE 0 END)::BIGINT AS r FROM epochs)
"""
