"""Hard negatives from a secondary sort of packed pair scores."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
BLOCK_BYTES = 16 << 20
SLICE_SCORES = 4_000_000
EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
POSITIVE, NEGATIVE = 0, 1
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)


def usable(df: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, one for each vec_id; components are ``floor(256 * x)``.

    Rows with a null id, label or vector, or with a null or non-finite component take no part. Of several rows under
    one id the one with the smallest label and vector counts.
    """
    label = F.col("label") if label is None else label
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fine = df.select(F.col("vec_id").cast("bigint"), label.cast("bigint").alias("label"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    one = fine.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))

    def whole(batches):
        for part in batches:
            column = part.column("vector")
            floors = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.ListArray.from_arrays(_offsets(column), pa.array(floors))],
                ["vec_id", "label", "vector"])

    return one.select("vec_id", "row.label", "row.vector").mapInArrow(whole, "vec_id bigint, label bigint, vector array<double>")


def _offsets(column: pa.ListArray) -> pa.Array:
    sizes = np.diff(column.offsets.to_numpy())
    return pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))


def inner_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered rows, exact; beyond 64 bits they stop at the ends of the range."""
    bound = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, a.shape[1])
    if bound < EXACT:
        return (a @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(x).T if a.shape[1] else np.zeros((len(a), len(x)), object)
    return np.clip(exact, NONE + 1, LAST).astype(np.int64)


def pack(anchor: np.ndarray, score: np.ndarray, kind, ids: np.ndarray) -> list[bytes]:
    """Keys whose byte order is (anchor, descending score, positives first, id)."""
    keys = np.empty(len(anchor), KEY)
    keys["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ _SIGN
    keys["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    keys["kind"] = kind
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    return [k.tobytes() for k in keys]


def unpack(keys: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, score, kind, id) of packed keys."""
    got = np.frombuffer(b"".join(keys), KEY)
    signed = lambda v: (v.astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
    yield from zip(signed(got["anchor"]), signed(~got["score"].astype(np.uint64)), got["kind"].tolist(), signed(got["id"]), strict=True)


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole scores n with low * positive <= 100 * n <= high * positive; empty where the first exceeds the second."""
    return -(-low * positive // 100), high * positive // 100


def _first(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest scores of each row that are not ``NONE``; of ties the first. Overwrites."""
    rows, columns = [], []
    every = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        here = scores[every, at] > NONE
        rows.append(every[here])
        columns.append(at[here])
        scores[every, at] = NONE
    return np.concatenate(rows or [every[:0]]), np.concatenate(columns or [every[:0]])


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.asarray(v, float) for v in table.column(name).to_pylist()]


def pairs_in_blocks(rows: DataFrame, anchors: DataFrame, choose, block_bytes: int) -> DataFrame:
    """(key) of the pairs that ``choose`` takes from the scores of every anchor with every row, in blocks.

    Rows and anchors are dealt by hashes into blocks of about ``block_bytes``; each block of rows meets each block of anchors
    once, so a task holds two blocks and a slice of their scores whatever the sizes of the tables.
    """
    size = F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0))
    count = lambda df: max(1, -(-int(df.agg(size).first()[0]) // block_bytes))
    high, wide = count(anchors), count(rows)
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Fresh column names: both sides may come from the same table.
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], spot(high).alias("i"), every(wide).alias("j"))
    right = rows.withColumn("j", spot(wide)).withColumn("i", every(high))

    def meet(a: pa.Table, x: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        if a.num_rows and x.num_rows:
            x = x.sort_by("vec_id")
            va, vx = _lists(a, "vector"), _lists(x, "vector")
            na, nx = np.array([len(v) for v in va]), np.array([len(v) for v in vx])
            for n in np.intersect1d(na, nx):  # vectors of different lengths have no inner product
                own, other = np.flatnonzero(na == n), np.flatnonzero(nx == n)
                xs, step = np.array([vx[i] for i in other]).reshape(len(other), n), max(1, SLICE_SCORES // len(other))
                facts = x.select(["vec_id", "label"]).take(pa.array(other))
                ids, labels = (facts.column(c).to_numpy() for c in ("vec_id", "label"))
                for start in range(0, len(own), step):
                    at = own[start:start + step]
                    scores = inner_products(np.array([va[i] for i in at]).reshape(len(at), n), xs)
                    keys += choose(a.take(pa.array(at)), scores, ids, labels)
        return pa.table([pa.array(keys, pa.binary())], ["key"])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "key binary")


def nearest_positives(count: int):
    """Chooser: the first ``count`` rows of the anchor's label in a block."""
    def choose(anchors: pa.Table, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[bytes]:
        own, own_label = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
        other = (own_label[:, None] != labels) | (own[:, None] == ids)
        value = np.where(other, NONE, scores)
        r, c = _first(value, count)
        return pack(own[r], scores[r, c], POSITIVE, ids[c])

    return choose


def windowed_negatives(count: int, low: int, high: int):
    """Chooser: the first ``count`` rows of another label inside each window of an anchor, in a block."""
    def choose(anchors: pa.Table, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[bytes]:
        own, own_label = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
        bounds = [[window(p, low, high) for p in ps] for ps in anchors.column("positives").to_pylist()]
        other = own_label[:, None] != labels
        taken = set()
        for turn in range(max(map(len, bounds), default=0)):
            with_turn = np.array([i for i, b in enumerate(bounds) if len(b) > turn])
            least, most = (np.array([bounds[i][turn][k] for i in with_turn])[:, None] for k in (0, 1))
            here = scores[with_turn]
            r, c = _first(np.where(other[with_turn] & (here >= least) & (here <= most), here, NONE), count)
            taken.update(zip(with_turn[r].tolist(), c.tolist(), strict=True))
        if not taken:
            return []
        r, c = np.array(sorted(taken)).T
        return pack(own[r], scores[r, c], NEGATIVE, ids[c])

    return choose


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """Keys dealt by anchor and sorted inside each partition: repartitionAndSortWithinPartitions on packed keys."""
    return pairs.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


def first_positives(pairs: DataFrame, count: int) -> DataFrame:
    """(anchor_id, score, positive_id) of the first ``count`` keys of each anchor in a sorted stream."""
    def run(batches):
        anchor, seen = None, 0
        for part in batches:
            out = []
            for own, score, _, other in unpack(part.column("key").to_pylist()):
                anchor, seen = own, seen + 1 if own == anchor else 1
                if seen <= count:
                    out.append((own, score, other))
            yield _batch(out, ["anchor_id", "score", "positive_id"])

    return secondary_sort(pairs).mapInArrow(run, "anchor_id bigint, score bigint, positive_id bigint")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def emit_negatives(pairs: DataFrame, positives: int, count: int, low: int, high: int) -> DataFrame:
    """Stream each anchor's keys in descending score: a positive opens a window, negatives inside open windows are emitted.

    At equal scores positives come first, so a window is open before any of its negatives passes. An anchor's state is
    its open windows; a window closes when it is full or the scores have fallen below it.
    """
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def run(batches):
        anchor, opened, windows = None, 0, []
        for part in batches:
            out = []
            for own, score, kind, other in unpack(part.column("key").to_pylist()):
                if own != anchor:
                    anchor, opened, windows = own, 0, []
                if kind == POSITIVE:
                    if opened < positives:
                        opened += 1
                        windows.append([other, score, *window(score, low, high), 0])
                    continue
                for w in windows:
                    if w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((own, w[0], w[4], other, w[1], score))
                windows = [w for w in windows if w[4] < count and w[2] <= score]
            yield _batch(out, names)

    schema = "anchor_id bigint, positive_id bigint, rank bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    return secondary_sort(pairs).mapInArrow(run, schema).withColumn("rank", F.col("rank").cast("int"))


def mine(
    df: DataFrame, every: int = 50, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are its first ``positives`` other rows of the
    same label by descending integer inner product, ties by the smaller vec_id. For each positive the first
    ``negatives`` rows of another label are returned whose score lies between ``low`` and ``high`` percent of the positive's.

    Blocks of anchors and rows hand on the pairs that can be among the first: a block's first positives, then, once the
    windows are known, its first negatives of each. Pairs are packed into (anchor, descending score, id) keys,
    shuffled by anchor and sorted in their partitions, and one streaming pass opens the positives' windows and
    emits the negatives, so no anchor's pairs are ever held together. Every pair is scored.

    Rows with a null id, label or vector or a null or non-finite component take no part; of rows that share an id
    the one with the smallest label and vector counts; vectors of different lengths form no pair; scores beyond 64 bits stop at the
    ends of the range. An anchor without positives or negatives, and an empty table, give no rows. Other columns are
    not read.
    """
    rows = stored(usable(df, label), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    near = stored(first_positives(pairs_in_blocks(rows, anchors, nearest_positives(positives), block_bytes), positives), "positives")
    scores = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list("score")).alias("positives"))
    far = pairs_in_blocks(rows, anchors.join(scores, "vec_id"), windowed_negatives(negatives, low, high), block_bytes)
    opened = near.select(packed_key("anchor_id", "score", POSITIVE, "positive_id").alias("key"))
    return emit_negatives(far.union(opened), positives, negatives, low, high)


def packed_key(anchor: str, score: str, kind: int, other: str) -> Column:
    """``pack`` as a column."""
    flipped = lambda c: F.unhex(F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(NONE))), 16, "0"))
    falling = F.unhex(F.lpad(F.hex(F.bitwise_not(F.col(score).bitwiseXOR(F.lit(NONE)))), 16, "0"))
    return F.concat(flipped(anchor), falling, F.lit(bytes([kind])), flipped(other))


def relabelled(modulus: int = 7, labels: int = 10) -> Column:
    """The label of the registered query: the next of ten where vec_id is divisible by seven."""
    return F.when(F.col("vec_id") % modulus == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(
    list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
pairs AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_dot_product(a.v, x.v)::BIGINT AS score
  FROM fine a JOIN fine x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
