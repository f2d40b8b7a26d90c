"""Near-duplicate documents: SuperMinHash signatures, banding, exact confirmation, grouping."""

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, small_batches, stored, text_bytes
from shelfmark.plans.skew import few_against_many, measured_small

BAND_ROWS = 5
BANDS = 32
PLACES = BAND_ROWS * BANDS
PERCENT = 80
STAR_ROUNDS = 2
DENSE_BUCKET = 48
BLOCK_SETS = 256
MATRIX_COLUMNS = 2048
SLICE_BYTES = 1 << 20
BATCH_ELEMENTS = 50_000
_FRACTION_BITS = 40
_UNSET = np.int64(1) << 62
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of each text.

    A to Z are lower-cased and words are runs of non-blank bytes. A text of fewer words has one
    shingle, its whole sequence; a text without words has none.
    """
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))[flat]
    out, start = [], 0
    for n in counts:
        own = hashes[start:start + n]
        start += n
        size = min(width, int(n))
        key = np.full(max(0, int(n) - size + 1) if n else 0, size, np.uint64)
        for k in range(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[k:k + len(key)])
        out.append(np.unique(key))
    return out


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, a row for each set (Ertl 2017).

    Element by element the values ``rank + uniform`` fall on the places of a random permutation; in
    round ``rank`` every element of every unfinished set sets one place (a Fisher-Yates step), and a set is
    finished when no later round can lower any of its places.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    keys = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    values = np.full(len(sets) * places, _UNSET, np.int64)
    order = np.empty((len(keys), places), np.uint8 if places <= 256 else np.uint16)
    order[:] = np.arange(places)
    live = np.arange(len(keys))
    with np.errstate(over="ignore"):
        for rank in range(places):
            if not len(live):
                break
            draw = mix(keys[live] + np.uint64((0x9E3779B97F4A7C15 * (2 * rank + 1)) & _MASK))
            other = mix(draw + np.uint64(0xD1B54A32D192ED03))
            pick = rank + ((other >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
            place = order[live, pick].astype(np.int64)
            order[live, pick] = order[live, rank]
            order[live, rank] = place
            value = (np.int64(rank) << _FRACTION_BITS) | (draw >> np.uint64(64 - _FRACTION_BITS)).astype(np.int64)
            np.minimum.at(values, owner[live] * places + place, value)
            if rank < places - 1:
                done = values.reshape(len(sets), places).max(axis=1) >> _FRACTION_BITS <= rank
                live = live[~done[owner[live]]]
    return values.reshape(len(sets), places)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket for each band of each signature; the band's number is part of it."""
    blocks = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands))
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + blocks[:, :, r])
    return key.astype(np.int64)


def _grouped(sets: list[np.ndarray], limit: int) -> Iterator[list[np.ndarray]]:
    group, size = [], 0
    for s in sets:
        if group and size + len(s) > limit:
            yield group
            group, size = [], 0
        group.append(s)
        size += len(s)
    if group:
        yield group


def sketch(docs: DataFrame, width: int, rows: int = BAND_ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, set_key (hash of the whole set, null for an empty one) and the band buckets."""
    schema = "doc_id bigint, n_shingles bigint, set_key binary, buckets array<bigint>"

    def run(batches):
        for part in slices(batches, "data", SLICE_BYTES):
            sets = shingle_sets(part.column("data").to_pylist(), width)
            buckets = np.concatenate([
                band_hashes(signatures(g, rows * bands), bands, rows) for g in _grouped(sets, BATCH_ELEMENTS)
            ])
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            offsets = np.arange(0, buckets.size + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets.ravel()))],
                ["doc_id", "n_shingles", "set_key", "buckets"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("data")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids``; shingles as sorted 64-bit hashes in bytes."""
    def run(batches):
        for part in slices(batches, "data", SLICE_BYTES):
            sets = shingle_sets(part.column("data").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    few = F.broadcast(ids) if measured_small(ids) else ids
    chosen = docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("data")).join(few, "doc_id", "left_semi")
    return chosen.mapInArrow(run, "doc_id bigint, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets meet ``100 * intersection >= percent * union``."""
    def run(batches):
        for part in batches:
            good = []
            for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if 100 * min(len(u), len(v)) >= percent * max(len(u), len(v)) and len(u) and len(v):
                    both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(u) + len(v) - both))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = few_against_many(pairs.withColumn("doc_id", F.col("a")), sets.withColumnRenamed("shingles", "left"),
                            ["doc_id"], ["b"]).select("a", "b", "left")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    return left.join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def spanning_edges(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: the same connections with one edge per document at most."""
    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for part in batches:
            for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in parent]
        found = [(x, r) for x, r in found if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each connected document and the smallest id it reaches; ids that reach no smaller one are left out.

    Alternating large and small stars (Kiveris et al. 2014) over edges that each partition has first
    reduced by union-find. Every round is stored, and the driver sees two numbers of a round.
    """
    def smallest(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "v")

    now = stored(spanning_edges(edges), "edges")
    seen = None
    while True:
        both = now.select(F.col("a").alias("v"), F.col("b").alias("u")).union(now.select(F.col("b").alias("v"), F.col("a").alias("u")))
        large = smallest(both).where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        least = down.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            down.join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        now = stored(small, "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now
        seen = mark


def dense_links(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components of (bucket, node, label) rows from crowded buckets.

    Crowded buckets that share nodes are one crowd. Every node outside a crowd's largest component is
    compared with every node of the crowd, in blocks of about ``BLOCK_SETS`` full sets each; of each pair of
    components a block returns one link, so pairs are counted and never listed.
    """
    low = crowds.groupBy("bucket").agg(F.min("node").alias("b"))
    edges = crowds.join(low, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    crowd_of = components(edges).select(F.col("a").alias("node"), F.col("b").alias("crowd"))
    nodes = crowds.select("node", "label").distinct().join(crowd_of, "node", "left").select(
        "node", "label", F.coalesce("crowd", "node").alias("crowd"))
    nodes = stored(nodes, "crowds")
    shares = nodes.groupBy("crowd", "label").agg(F.count(F.lit(1)).alias("n"))
    facts = shares.groupBy("crowd").agg(
        F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all")).select(
        "crowd", F.col("most.label").alias("main"),
        F.ceil(F.col("all") / BLOCK_SETS).cast("int").alias("wide"),
        F.ceil((F.col("all") - F.col("most.n")) / BLOCK_SETS).cast("int").alias("high")).where("high > 0")
    rows = nodes.join(facts, "crowd").join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    spot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few = rows.where("label <> main").select(
        spot(F.col("high")).alias("i"), every(F.col("wide")).alias("j"),
        *[F.col(c).alias(c) for c in ("crowd", "node", "label", "shingles")])
    many = rows.select(
        "crowd", every(F.col("high")).alias("i"), spot(F.col("wide")).alias("j"), "node", "label", "shingles")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        links = {}
        if left.num_rows and right.num_rows:
            x, y = ([np.frombuffer(v, np.uint64) for v in t.column("shingles").to_pylist()] for t in (left, right))
            n = len(x)
            sizes = np.array([len(v) for v in (*x, *y)])
            _, place, often = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            column = np.cumsum(often > 1) - 1  # a shingle of one set alone is in no intersection
            shared = often[place] > 1
            place, owner = column[place[shared]], owner[shared]
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            both = np.zeros((n, len(y)))
            for start in range(0, int(place[-1]) + 1 if len(place) else 0, MATRIX_COLUMNS):
                s, e = np.searchsorted(place, [start, start + MATRIX_COLUMNS])
                grid = np.zeros((len(sizes), MATRIX_COLUMNS), np.float32)
                grid[owner[s:e], place[s:e] - start] = 1
                both += grid[:n] @ grid[n:].T
            good = 100 * both >= percent * (sizes[:n, None] + sizes[None, n:] - both)
            a, la = (left.column(c).to_numpy() for c in ("node", "label"))
            b, lb = (right.column(c).to_numpy() for c in ("node", "label"))
            for i, j in np.argwhere(good & (la[:, None] != lb[None, :])):
                links.setdefault((la[i], lb[j]), (int(a[i]), int(b[j])))
        pairs = sorted(links.values())
        return pa.table([pa.array([p for p, _ in pairs], pa.int64()), pa.array([q for _, q in pairs], pa.int64())], ["a", "b"])

    keys = ["crowd", "i", "j"]
    return few.groupBy(*keys).cogroup(many.groupBy(*keys)).applyInArrow(compare, "a bigint, b bigint")


def linked(docs: DataFrame, width: int, percent: int = PERCENT, rows: int = BAND_ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    Documents are linked when their distinct shingle sets meet the threshold. Equal sets are one node, named by
    their smallest id. Nodes that share a band bucket are candidates: for some rounds each is
    compared with one drawn member of its bucket, and at the end all pairs of a bucket that are still in
    different components are compared (crowded buckets in blocks), so every link between candidates counts.

    Null and empty texts have no shingles and link with nothing. Rows that share a doc_id are one
    document and always one component. Rows without an id cannot be named: they keep a null
    component and are kept. No rows give no rows; columns besides doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    sketches = stored(sketch(docs, width, rows, bands), "sketches")
    named = sketches.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    nodes = named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("buckets").alias("buckets"))
    nodes = stored(nodes, "nodes")
    entries = nodes.select("node", F.explode("buckets").alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    members = stored(entries.join(crowded.select("bucket"), "bucket", "left_semi").distinct(), "members")
    sets = stored(full_sets(docs, members.select(F.col("node").alias("doc_id")).distinct(), width), "sets")

    # A document that occurs with several texts ties their nodes together.
    twice = named.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y")
    keyed = named.select("doc_id", "set_key").join(nodes.select("set_key", "node"), "set_key")
    edges = keyed.join(twice.select("doc_id"), "doc_id", "left_semi").where("doc_id <> node").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    label = components(edges)
    tested, turn = None, 0
    while turn <= STAR_ROUNDS:
        at = members.join(label.select(F.col("a").alias("node"), F.col("b").alias("l")), "node", "left").select(
            "bucket", "node", F.coalesce("l", "node").alias("label"))
        draw = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "label")
        pivots = at.groupBy("bucket").agg(
            F.min(draw).alias("pivot"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
        pivots = pivots.where("lo < hi")
        found = []
        if turn < STAR_ROUNDS:
            met = at.join(pivots, "bucket").where("label <> pivot.label").select(
                F.col("node").alias("a"), F.col("pivot.node").alias("b"))
        else:
            found.append(dense_links(at.join(pivots.where(F.col("n") > DENSE_BUCKET).select("bucket"), "bucket", "left_semi"), sets, percent))
            open_ = at.join(pivots.where(F.col("n") <= DENSE_BUCKET).select("bucket"), "bucket", "left_semi")
            other = open_.select("bucket", F.col("node").alias("b"), F.col("label").alias("other"))
            met = open_.join(other, "bucket").where("label < other").select(F.col("node").alias("a"), "b")
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty() and turn < STAR_ROUNDS:
            turn = STAR_ROUNDS
            continue
        found = stored(reduce(DataFrame.union, [confirmed(pairs, sets, percent), *found]), "links")
        tested = pairs if tested is None else tested.union(pairs)
        if not found.isEmpty():
            label = components(label.union(found))
        turn += 1
    reps = nodes.join(label.select(F.col("a").alias("node"), "b"), "node", "left").select(
        "set_key", F.coalesce("b", "node").alias("component_id"))
    placed = named.join(reps, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("doc_id IS NULL OR set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each component, the one with the smallest id; columns pass unchanged.

    Rows that share a doc_id are one document, of which one row stays.
    """
    found = linked(docs, width)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    often = found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    gone, often = stored(gone, "copies"), stored(often, "repeated")
    bounded = lambda ids: F.broadcast(ids) if measured_small(ids) else ids
    left = docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    if often.isEmpty():
        return left
    once = left.join(bounded(often), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return left.join(bounded(often), "doc_id", "left_anti").select(*docs.columns).union(once)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id))::BIGINT AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id
"""
