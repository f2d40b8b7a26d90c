"""Ranked lexical search: a block-compressed inverted index answered by Block-Max MaxScore."""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, stored, text_bytes

TOP = 10
BLOCK_POSTINGS = 64
SEGMENT_BYTES = 8 << 20
QUERY_BYTES = 16 << 20
NO_ID = (1 << 63) - 1
# Bytes of terms: digits, letters (A to Z lower-cased) and everything beyond ASCII; all others end a term.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
BLOCKS = "segment bigint, term binary, block int, first int, last int, n int, tops array<bigint>, data binary"
DOCUMENTS = "segment bigint, doc int, doc_id bigint, n_terms bigint"


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, low ones first, and the number of bytes of every value."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= 1 << 7 * k
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[starts[has] + k] = (values[has] >> 7 * k & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out, sizes


def decoded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127) << 7 * place, starts)


def segment_blocks(texts: list[bytes], block: int = BLOCK_POSTINGS) -> tuple[list, np.ndarray]:
    """The posting blocks of a segment, in the order of terms and documents, and the number of terms of each text.

    A block holds up to ``block`` postings of a term, gaps between documents and frequencies interleaved. Its
    ``tops`` are the (frequency, document length) pairs that no other posting of the block beats in both, so
    the largest contribution in the block is known for any weight and any corpus statistics.
    """
    ids: dict[bytes, int] = {}
    words = [t.translate(TERM_BYTES).split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for w in words:
        for t in w:
            if t not in ids:
                ids[t] = len(ids)
    if not ids:
        return [pa.array([], t) for t in (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())], lengths
    names = pa.array(list(ids), pa.binary())
    order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable") if len(ids) > 1 else np.zeros(1, np.int64)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    flat = rank[np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))]
    keys, tf = np.unique(flat * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    term, doc = np.divmod(keys, len(texts))
    head = np.r_[True, term[1:] != term[:-1]]
    place = np.arange(len(term)) - np.maximum.accumulate(np.where(head, np.arange(len(term)), 0))
    start = np.flatnonzero(place % block == 0)
    end = np.r_[start[1:], len(term)]
    owner = np.repeat(np.arange(len(start)), end - start)
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    data, sizes = varints(np.c_[gap, tf].ravel())
    ends = np.cumsum(sizes)[2 * end - 1]
    # Postings of a block by falling frequency, then length; those shorter than all before are its tops.
    n = lengths[doc]
    best = np.lexsort((n, -tf, owner))
    by_owner, value = owner[best], n[best]
    low = _running_least(value, by_owner)
    top = np.r_[True, (value[1:] < low[:-1]) | (by_owner[1:] != by_owner[:-1])]
    tops = best[top]
    counts = 2 * np.bincount(owner[tops], minlength=len(start))
    return [
        names.take(pa.array(order[term[start]])), pa.array((place[start] // block).astype(np.int32)),
        pa.array(doc[start].astype(np.int32)), pa.array(doc[end - 1].astype(np.int32)), pa.array((end - start).astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.c_[tf, n][tops].ravel().astype(np.int64))),
        pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)]),
    ], lengths


def _running_least(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least value so far inside each group of consecutive rows."""
    step = int(value.max(initial=0)) + 1
    shift = (len(group) and int(group[-1]) - group) * step  # later groups lie below earlier ones
    return np.minimum.accumulate(value + shift) - shift


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, block: int = BLOCK_POSTINGS) -> tuple[DataFrame, DataFrame]:
    """The stored index: posting blocks of all terms of all documents, and each document's id and length.

    Every task cuts its documents into segments of about ``segment_bytes`` of text (a longer text is a segment of its own)
    and inverts them where they are read; nothing is shuffled. A null text has no terms.
    """
    schema = BLOCKS + ", doc int, doc_id bigint, n_terms bigint"

    def run(batches):
        segment = TaskContext.get().partitionId() << 32
        for texts, ids in _segments(batches, segment_bytes):
            columns, lengths = segment_blocks(texts, block)
            n, m = len(columns[0]), len(texts)
            blank = lambda t, k: pa.nulls(k, t)
            names = [f.split()[0] for f in schema.split(", ")]
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            own = [pa.array(np.arange(m, dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, segment)), *[blank(t, m) for t in types[1:]], *own], names)
            for at in range(0, n, 65_536):
                part = [c.slice(at, 65_536) for c in columns]
                k = len(part[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, segment)), *part, *[blank(a.type, k) for a in own]], names)
            segment += 1

    both = stored(docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("data")).mapInArrow(run, schema), "index")
    return (both.where("term IS NOT NULL").select(*[f.split()[0] for f in BLOCKS.split(", ")]),
            both.where("doc IS NOT NULL").select(*[f.split()[0] for f in DOCUMENTS.split(", ")]))


def _segments(batches, limit: int) -> Iterator[tuple[list[bytes], list]]:
    texts, ids, size = [], [], 0
    for part in slices(batches, "data", limit):
        for text, doc_id in zip(part.column("data").to_pylist(), part.column("doc_id").to_pylist(), strict=True):
            if size and size + len(text) > limit:
                yield texts, ids
                texts, ids, size = [], [], 0
            texts.append(text)
            ids.append(doc_id)
            size += len(text)
    if texts:
        yield texts, ids


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    def run(batches):
        for part in batches:
            terms = [sorted(set(t.translate(TERM_BYTES).split())) for t in part.column("data").to_pylist()]
            at = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(pa.array(at)), pa.array(list(chain.from_iterable(terms)), pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("bigint"), text_bytes().alias("data")).mapInArrow(run, "item_id bigint, term binary").distinct()


def contributions(weight: int, tf: np.ndarray, lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds to documents in which it stands ``tf`` times."""
    m = 10 + 90 * lengths * n_docs // total
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


@dataclass
class PostingList:
    """The blocks of one term in one segment. A block is decompressed when a document first needs it."""

    weight: int
    first: np.ndarray
    last: np.ndarray
    bounds: np.ndarray
    data: list[bytes]
    scorer: "SegmentScorer"
    opened: dict = field(default_factory=dict)

    @property
    def bound(self) -> int:
        return int(self.bounds.max())

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.opened:
            pairs = decoded(self.data[i]).reshape(-1, 2)
            docs = self.first[i] + np.cumsum(pairs[:, 0])
            self.opened[i] = docs, self.scorer.add(self.weight, pairs[:, 1], docs)
        return self.opened[i]

    def everything(self) -> tuple[np.ndarray, np.ndarray]:
        docs, values = zip(*(self.block(i) for i in range(len(self.data))), strict=True)
        return np.concatenate(docs), np.concatenate(values)

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that may hold each document, -1 where none does."""
        at = np.searchsorted(self.last, docs)
        inside = at < len(self.last)
        inside[inside] = self.first[at[inside]] <= docs[inside]
        return np.where(inside, at, -1)

    def values(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Contributions to ``docs`` (ascending) that lie in ``blocks``."""
        out = np.zeros(len(docs), np.int64)
        for i in np.unique(blocks[blocks >= 0]).tolist():
            have, value = self.block(i)
            own = np.flatnonzero(blocks == i)
            at = np.searchsorted(have, docs[own])
            hit = at < len(have)
            hit[hit] = have[at[hit]] == docs[own[hit]]
            out[own[hit]] = value[at[hit]]
        return out


@dataclass
class SegmentScorer:
    """Answers queries on one segment; ``heaps`` holds the best of the segments before."""

    ids: np.ndarray
    lengths: np.ndarray
    n_docs: int
    total: int
    lists: dict[bytes, PostingList] = field(default_factory=dict)

    def add(self, weight: int, tf: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return contributions(weight, tf, self.lengths[docs], self.n_docs, self.total)

    def load(self, term: bytes, weight: int, first, last, tops: list[list[int]], data: list[bytes]) -> None:
        sizes = np.array([len(t) for t in tops]) // 2
        pairs = np.fromiter(chain.from_iterable(tops), np.int64).reshape(-1, 2)
        value = contributions(weight, pairs[:, 0], pairs[:, 1], self.n_docs, self.total)
        bounds = np.maximum.reduceat(value, np.r_[0, np.cumsum(sizes)[:-1]])
        self.lists[term] = PostingList(weight, np.asarray(first, np.int64), np.asarray(last, np.int64), bounds, data, self)

    def search(self, terms: list[bytes], heap: list, k: int) -> None:
        """Bring the ``k`` best of (score, -doc_id) into ``heap``.

        Lists are ordered by their bounds. Those whose bounds together stay below the ``k``-th score cannot
        lift a document into the result alone: only documents of the other, essential lists are candidates. Then the
        non-essential lists are visited from the largest bound down, and a candidate goes as soon as its score,
        the maximum of the one block that may hold it and the bounds of the lists still to come stay below the
        ``k``-th score, before that block is decompressed. A candidate at the ``k``-th score stays, as ties go to the smaller id.
        """
        lists = sorted((self.lists[t] for t in terms if t in self.lists), key=lambda p: p.bound)
        lists = [p for p in lists if p.bound > 0]
        if not lists:
            return
        least = heap[0][0] if len(heap) == k else 1
        upto = np.cumsum([p.bound for p in lists])
        cut = int(np.searchsorted(upto, least))  # the lists before it stay below the k-th score together
        if cut == len(lists):
            return
        scores = np.zeros(len(self.ids), np.int64)
        for p in lists[cut:]:
            docs, value = p.everything()
            scores[docs] += value
        docs = np.flatnonzero(scores)
        scores = scores[docs]
        for i in range(cut - 1, -1, -1):
            if len(docs) > k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            keep = scores + upto[i] >= least
            docs, scores = docs[keep], scores[keep]
            p = lists[i]
            blocks = p.block_of(docs)
            rest = upto[i - 1] if i else 0
            can = scores + np.where(blocks >= 0, p.bounds[blocks], 0) + rest >= least
            docs, scores, blocks = docs[can], scores[can], blocks[can]
            scores = scores + p.values(docs, blocks)
        if len(docs) > k:
            edge = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            keep = scores >= edge
            docs, scores = docs[keep], scores[keep]
        keep = scores >= least
        order = np.lexsort((self.ids[docs], -scores))
        for score, doc_id in zip(scores[order][:k].tolist(), self.ids[docs][order][:k].tolist(), strict=True):
            if len(heap) < k:
                heapq.heappush(heap, (score, -doc_id))
            elif (score, -doc_id) > heap[0]:
                heapq.heapreplace(heap, (score, -doc_id))


def _scan(rows: Iterator[pa.RecordBatch], queries: dict, weights: dict[bytes, int], n_docs: int, total: int, k: int, heaps: dict) -> None:
    """Read sorted rows of segments (documents first, then blocks by term) and answer all queries on each."""
    scorer, segment = None, None
    ids, lengths, open_ = [], [], None

    def close_term():
        nonlocal open_
        if open_:
            scorer.load(open_[0], weights[open_[0]], *open_[1:])
        open_ = None

    def finish():
        if segment is not None and scorer:
            close_term()
            for item, terms in queries.items():
                scorer.search(terms, heaps.setdefault(item, []), k)

    for part in rows:
        columns = {c: part.column(c).to_pylist() for c in ("segment", "term", "first", "last", "tops", "data", "doc_id", "n_terms")}
        for seg, term, first, last, tops, data, doc_id, n_terms in zip(*columns.values(), strict=True):
            if seg != segment:
                finish()
                segment, scorer, ids, lengths = seg, None, [], []
            if term is None:
                ids.append(NO_ID if doc_id is None else doc_id)
                lengths.append(n_terms)
                continue
            if scorer is None:
                scorer = SegmentScorer(np.array(ids, np.int64), np.array(lengths, np.int64), n_docs, total)
            if open_ and open_[0] != term:
                close_term()
            if not open_:
                open_ = (term, [], [], [], [])
            for kept, value in zip(open_[1:], (first, last, tops, data), strict=True):
                kept.append(value)
    finish()


def top_documents(blocks: DataFrame, documents: DataFrame, terms: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item of ``terms`` (item_id, term).

    Queries go to the tasks in parts of about ``query_bytes``, each a pass over the blocks of its own terms; a segment's blocks
    meet its documents in one task, which streams its segments and keeps one heap for each query, so later segments
    are pruned by earlier ones. The tasks' heaps are merged by rank.
    """
    spark = blocks.sparkSession
    n_docs, total = documents.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    df = blocks.groupBy("term").agg(F.sum("n").alias("df")).join(terms.select("term").distinct(), "term")
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weighted = stored(terms.join(df.select("term", weight.alias("weight")), "term"), "query_terms")
    size = weighted.agg(F.coalesce(F.sum(F.length("term") + 40), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // query_bytes))
    found = []
    for i in range(parts):
        rows = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).collect()
        queries: dict = {}
        for r in rows:
            queries.setdefault(r.item_id, []).append(bytes(r.term))
        found.append(_pass(blocks, documents, queries, {bytes(r.term): r.weight for r in rows}, n_docs, total, k))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _pass(blocks: DataFrame, documents: DataFrame, queries: dict, weights: dict, n_docs: int, total: int, k: int) -> DataFrame:
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((queries, weights))
    wanted = spark.createDataFrame([(bytearray(t),) for t in weights], "term binary")
    own = blocks.join(F.broadcast(wanted), "term", "left_semi")
    rows = own.unionByName(documents, allowMissingColumns=True).repartition("segment").sortWithinPartitions(
        "segment", F.asc_nulls_first("term"), "block", "doc")

    def run(batches):
        heaps: dict = {}
        _scan(batches, *sent.value, n_docs, total, k, heaps)
        best = [(item, None if -i == NO_ID else -i, score) for item, heap in heaps.items() for score, i in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b[c] for b in best], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return rows.select("segment", "term", "first", "last", "tops", "data", "doc_id", "n_terms").mapInArrow(
        run, "item_id bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, segment_bytes: int = SEGMENT_BYTES, block: int = BLOCK_POSTINGS,
                   query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents of each item, those that score above 0.

    All terms of all documents are indexed. Rows of ``docs`` are documents of their own, also when they share an id; one without
    an id is ranked last among equal scores. Rows of ``items`` that share an id are one item; a null item id is an id like
    others. Null and empty texts have no terms. Empty tables give no rows; other columns are not read.
    """
    blocks, documents = build_index(docs, segment_bytes, block)
    return top_documents(blocks, documents, query_terms(items), k, query_bytes)


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
stats AS (SELECT count(*) AS nd, sum(n)::BIGINT AS total FROM len),
w AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, stats WHERE term IN (SELECT term FROM q) GROUP BY term, nd),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), stats GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
