"""Approximate nearest neighbours by an inverted multi-index."""

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import stored

CENTROIDS = 32
SAMPLE_ROWS = 20_000
KMEANS_ROUNDS = 15
VISITED_SHARE = 0.6
VISITED_LEAST = 2_000
BLOCK_ROWS = 8_192
QUERY_BLOCK = 4_096
NEIGHBOURS = 20


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, as doubles.

    Null and zero vectors, vectors with null or non-finite components, rows without an id and
    vectors of another length than most are left out.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fine = df.select(F.col("vec_id").cast("bigint"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    usual = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("vector") == (usual.n if usual else 0))


def cluster(points: np.ndarray, k: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """Lloyd's k-means from spread-out starting points; the same points give the same centroids."""
    k = min(k, len(np.unique(points, axis=0)))
    centres = points[:1].copy()
    gap = ((points - centres[0]) ** 2).sum(1)
    draw = np.random.default_rng(7)
    for _ in range(1, k):
        total = gap.sum()
        pick = draw.choice(len(points), p=gap / total) if total > 0 else 0
        centres = np.vstack([centres, points[pick]])
        gap = np.minimum(gap, ((points - points[pick]) ** 2).sum(1))
    for _ in range(rounds):
        near = nearest(points, centres)
        for c in range(len(centres)):
            own = near == c
            if own.any():
                centres[c] = points[own].mean(0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * points @ centres.T, axis=1)


@dataclass
class MultiIndex:
    """Centroids of both halves, the bound on the norm, and the share of ids in each pair of centroids."""

    first: np.ndarray
    second: np.ndarray
    half: int
    norm: float
    counts: np.ndarray | None = None

    def halves(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The added component makes the nearest vector the one with the largest inner product."""
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm ** 2 - (x ** 2).sum(1)))
        return x[:, :self.half], np.c_[x[:, self.half:], lift]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return nearest(a, self.first) * len(self.second) + nearest(b, self.second)

    def visit(self, a: np.ndarray, b: np.ndarray, wanted: int) -> list[int]:
        """Cells in the order of the summed distance until ``wanted`` entries are met (multi-sequence heap)."""
        da = ((self.first - a) ** 2).sum(1)
        db = ((self.second - b) ** 2).sum(1)
        i_of, j_of = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        da, db = da[i_of].tolist(), db[j_of].tolist()
        counts, width = self.counts.tolist(), len(db)
        heap, out, met = [(da[0] + db[0], 0, 0)], [], 0
        while heap and met < wanted:
            _, i, j = heapq.heappop(heap)
            cell = i_of[i] * width + j_of[j]
            if counts[cell]:
                out.append(cell)
                met += counts[cell]
            if j + 1 < width:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(da):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def fit_index(vectors: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> MultiIndex | None:
    """Fit the centroids on the ``sample_rows`` vectors with the smallest hashes of id and vector."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(sample_rows).select("vector").collect()
    if not rows:
        return None
    norm = vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0] ** 0.5
    x = np.array([r.vector for r in rows])
    index = MultiIndex(x[:1], x[:1], max(1, x.shape[1] // 2), norm)
    a, b = index.halves(x)
    index.first, index.second = cluster(a, centroids), cluster(b, centroids)
    return index


def search(
    df: DataFrame, every: int = 20, k: int = NEIGHBOURS, share: float = VISITED_SHARE, block_rows: int = BLOCK_ROWS,
    query_block: int = QUERY_BLOCK, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each id divisible by ``every``.

    All usable vectors are indexed, repeated rows once. A query visits cells in the order of their summed centroid
    distance until it has met ``share`` of all entries, of which an id's vectors share one; these are ranked by the inner product of the original vectors in
    double precision, ties by the smaller id. A row of cells is cut into blocks of about ``block_rows``
    entries, so a crowded cell is met by many tasks.

    Rows that share an id count as one vector with the larger score. No usable rows give no rows.
    """
    spark = df.sparkSession
    out = "query_id bigint, vec_id bigint, score double"
    vectors = stored(usable(df).distinct(), "vectors")
    index = fit_index(vectors, centroids, sample_rows)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def place(batches):
        for part in batches:
            if part.num_rows:
                cells = index.cells(_matrix(part.column("vector")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32())], [*part.schema.names, "cell"])

    entries = stored(vectors.mapInArrow(place, "vec_id bigint, vector array<double>, cell int"), "entries")
    width = len(index.second)
    index.counts, sizes = np.zeros(len(index.first) * width), np.zeros(len(index.first) * width, np.int64)
    placed = entries.groupBy("vec_id", "cell").count()
    per_id = placed.groupBy("vec_id").agg(F.sum("count").alias("all"))
    for r in placed.join(per_id, "vec_id").groupBy("cell").agg(
        F.sum("count").alias("n"), F.sum(F.col("count") / F.col("all")).alias("share")).collect():
        index.counts[r.cell], sizes[r.cell] = r["share"], r["n"]
    wanted = max(VISITED_LEAST, int(np.ceil(share * index.counts.sum())))
    blocks = np.ceil(sizes.reshape(-1, width).sum(1) / block_rows).astype(int)
    n_queries = vectors.where(F.col("vec_id") % every == 0).count()
    query_blocks = max(1, -(-n_queries // query_block))

    def traverse(batches):
        for part in batches:
            if not part.num_rows:
                continue
            x = _matrix(part.column("vector"))
            a, b = index.halves(x, query=True)
            picked, rows, cells = [], [], []
            for q in range(len(x)):
                by_row: dict[int, list[int]] = {}
                for cell in index.visit(a[q], b[q], wanted):
                    by_row.setdefault(cell // width, []).append(cell)
                for row, own in by_row.items():
                    picked.append(q)
                    rows.append(row)
                    cells.append(own)
            at = pa.array(picked, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(at), part.column("vector").take(at), pa.array(rows, pa.int32()),
                 pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "vector", "row", "cells"])

    n_blocks = F.element_at(F.array(*[F.lit(int(max(1, n))) for n in blocks]), F.col("row") + 1)
    visits = (
        vectors.where(F.col("vec_id") % every == 0)
        .mapInArrow(traverse, "vec_id bigint, vector array<double>, row int, cells array<int>")
        .withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    )
    spread = (
        entries.withColumn("row", F.floor(F.col("cell") / width).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = [], []
        if left.num_rows and right.num_rows:
            x = _matrix(left.column("vector").combine_chunks())
            vec_ids, cells = left.column("vec_id").to_numpy(), left.column("cell").to_numpy()
            keep = _least_ids(x, vec_ids, k + 1)
            keep = keep[np.argsort(vec_ids[keep], kind="stable")]
            x, vec_ids, cells = x[keep], vec_ids[keep], cells[keep]
            q = _matrix(right.column("vector").combine_chunks())
            approx = q @ x.T
            here = np.full(int(cells.max()) + 1, False)
            for n, (query, own) in enumerate(zip(right.column("vec_id").to_pylist(), right.column("cells").to_pylist(), strict=True)):
                here[:] = False
                here[[c for c in own if c < len(here)]] = True
                at = np.flatnonzero(here[cells] & (vec_ids != query))
                if len(at) > k:
                    value = approx[n, at]
                    fresh = np.flatnonzero(np.r_[True, vec_ids[at][1:] != vec_ids[at][:-1]])
                    if len(fresh) > k:  # the vectors of an id stand together; the best of each counts
                        top = np.maximum.reduceat(value, fresh)
                        edge = np.partition(top, len(top) - k)[len(top) - k]
                        at = at[value >= edge - 1e-9 * (1 + abs(edge))]
                score = (x[at] * q[n]).sum(-1)
                best = np.lexsort((vec_ids[at], -score))
                best = best[np.sort(np.unique(vec_ids[at][best], return_index=True)[1])[:k]]
                ids.append((query, len(best)))
                rows.append((vec_ids[at][best], score[best]))
        return pa.table([
            pa.array(np.repeat([i for i, _ in ids], [m for _, m in ids]) if ids else [], pa.int64()),
            pa.array(np.concatenate([v for v, _ in rows]) if rows else [], pa.int64()),
            pa.array(np.concatenate([s for _, s in rows]) if rows else [], pa.float64()),
        ], ["query_id", "vec_id", "score"])

    keys = ["row", "block", "part"]
    met = spread.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(meet, out)
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _least_ids(x: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Rows left when of equal vectors only the ``n`` smallest ids stay; no other can be among the nearest."""
    order = np.lexsort((ids, *x.T))
    y = x[order]
    fresh = np.r_[True, (y[1:] != y[:-1]).any(1)]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(y)), 0))
    return np.sort(order[np.arange(len(y)) - start < n])
