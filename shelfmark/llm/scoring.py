"""Language-model scores: a Katz backoff model counted, stored and evaluated with Spark."""

import gc
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, split_remainder, stored, text_bytes
from shelfmark.llm.neardup import mix

FOLDS, HELD_OUT = 7, 2
LARGEST_DISCOUNTED = 5
CHUNK_BYTES = 8 << 20
KEYS_PER_BUCKET = 600_000
SLICE_BYTES = 2 << 20
END = b" "  # no word holds a blank

CHUNK = ("chunk string, doc_ids array<bigint>, sizes array<int>, hashes binary, tokens binary, n_words bigint, "
         "n_tokens bigint")
REQUEST = "bucket bigint, chunk string, kind string, keys binary, a binary, b binary, c binary"
ANSWER = "chunk string, kind string, bucket bigint, a binary, b binary, stats array<bigint>"


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def tokenised(docs: DataFrame) -> DataFrame:
    """One row for each chunk of documents: ids, sizes (with the end token), word hashes and token numbers.

    A chunk numbers its words by falling frequency, so common words have small numbers.
    """
    def chunk_row(name, ids, sizes, vocabulary, parts):
        tokens = np.concatenate(parts)
        seen = np.bincount(tokens, minlength=len(vocabulary))
        order = np.argsort(-seen, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))[order]
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
             pa.array([hashes.tobytes()], pa.binary()), pa.array([pack(place[tokens])], pa.binary()),
             pa.array([len(vocabulary)], pa.int64()), pa.array([len(tokens)], pa.int64())],
            ["chunk", "doc_ids", "sizes", "hashes", "tokens", "n_words", "n_tokens"])

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        ids, sizes, parts, held, vocabulary = [], [], [], 0, None
        for part in slices(batches, "data", SLICE_BYTES):
            if vocabulary is None:
                vocabulary = defaultdict()
                vocabulary.default_factory = vocabulary.__len__
            for doc_id, data in zip(part.column("doc_id").to_pylist(), part.column("data").to_pylist(), strict=True):
                words = data.lower().split()
                words.append(END)
                ids.append(doc_id)
                sizes.append(len(words))
                parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
                held += len(data)
            if held >= CHUNK_BYTES:
                yield chunk_row(f"{task:08d}-{n:06d}", ids, sizes, vocabulary, parts)
                n += 1
                ids, sizes, parts, held, vocabulary = [], [], [], 0, None
        if ids:
            yield chunk_row(f"{task:08d}-{n:06d}", ids, sizes, vocabulary, parts)

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("data")).mapInArrow(run, CHUNK)


@dataclass
class Chunk:
    """A chunk read back: token streams as words (by hash order) and as word pairs."""

    doc_ids: list
    sizes: np.ndarray
    train: np.ndarray          # of tokens
    keys: np.ndarray           # sorted hashes of the chunk's words
    word: np.ndarray           # of tokens, as places in keys
    before: np.ndarray         # the word before; the end token where a document starts

    @staticmethod
    def read(row: dict) -> "Chunk":
        hashes = np.frombuffer(row["hashes"], np.uint64)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = hashes[order]
        word = place[unpack(row["tokens"], np.uint32)]
        sizes = np.array(row["sizes"], np.int64)
        train = np.repeat([split_remainder(i, FOLDS) != HELD_OUT for i in row["doc_ids"]], sizes)
        end = int(np.searchsorted(keys, np.uint64(xxhash.xxh3_64_intdigest(END))))
        before = np.roll(word, 1)
        before[np.cumsum(sizes) - sizes] = end
        return Chunk(row["doc_ids"], sizes, train, keys, word, before)

    def pairs(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.keys[self.before] * np.uint64(0x9E3779B97F4A7C15) + mix(self.keys[self.word]))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Even ranges of the key space in ascending order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def requests(chunk: str, kind: str, buckets: int, keys: np.ndarray, **values) -> pa.RecordBatch:
    at = bucket_of(keys, buckets)
    cut = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)] if len(at) else np.zeros(1, int)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    column = lambda name: pa.array([pack(values[name][s:e]) if name in values else None for s, e in spans], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([int(at[s]) for s, _ in spans], pa.int64()), pa.array([chunk] * len(spans), pa.string()),
         pa.array([kind] * len(spans), pa.string()), pa.array([pack_sorted(keys[s:e]) for s, e in spans], pa.binary()),
         column("a"), column("b"), column("c")],
        ["bucket", "chunk", "kind", "keys", "a", "b", "c"])


def _rows(batches):
    for part in batches:
        yield from part.to_pylist()


def count_words(buckets: int):
    def run(batches):
        for row in _rows(batches):
            chunk = Chunk.read(row)
            counts = np.bincount(chunk.word[chunk.train], minlength=len(chunk.keys)).astype(np.uint64)
            yield requests(row["chunk"], "word", buckets, chunk.keys, a=counts)
    return run


def count_pairs(buckets: int):
    def run(batches):
        for row in _rows(batches):
            chunk = Chunk.read(row)
            pairs = chunk.pairs()
            keys = np.unique(pairs)
            seen, n = np.unique(pairs[chunk.train], return_counts=True)
            counts = np.zeros(len(keys), np.uint64)
            counts[np.searchsorted(keys, seen)] = n
            yield requests(row["chunk"], "pair", buckets, keys, a=counts)
    return run


def _gathered(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """Requests of a bucket by chunk, their keys end to end, the distinct keys, and the place of each key in these."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [unpack_sorted(r.pop("keys")) for r in rows]
    every = np.concatenate(keys)
    distinct, place = np.unique(every, return_inverse=True)
    return rows, np.cumsum([0, *map(len, keys)]), distinct, place


def _answers(rows, a, b=None, stats=None) -> pa.Table:
    first = rows[0]
    return pa.table([
        pa.array([r["chunk"] for r in rows] + [None], pa.string()), pa.array([r["kind"] for r in rows] + [first["kind"]], pa.string()),
        pa.array([r["bucket"] for r in rows] + [first["bucket"]], pa.int64()),
        pa.array([*a, None], pa.binary()), pa.array([*(b or [None] * len(rows)), None], pa.binary()),
        pa.array([None] * len(rows) + [stats or []], pa.list_(pa.int64())),
    ], ["chunk", "kind", "bucket", "a", "b", "stats"])


def sum_counts(table: pa.Table) -> pa.Table:
    """Total count of every key, sent back to the chunks that asked; each key is owned by the first of them."""
    rows, cut, distinct, place = _gathered(table)
    total = np.bincount(place, np.concatenate([unpack(r["a"], np.uint64) for r in rows]).astype(float), len(distinct)).astype(np.uint64)
    owned = np.zeros(len(place), bool)
    owned[np.unique(place, return_index=True)[1]] = True
    answer = (total[place] << np.uint64(1)) | owned.astype(np.uint64)
    tops = [int((total == r).sum()) for r in range(1, LARGEST_DISCOUNTED + 2)]
    stats = [int(total.sum()), int((total > 0).sum()), *tops]
    return _answers(rows, [pack(answer[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)], stats=stats)


def backoff_weights(table: pa.Table) -> pa.Table:
    """log10 of the backoff weight and of the factor on seen words, of every history.

    A history's seen words keep the sum of their discounted counts; what is left goes to the other words in
    proportion to their unigram probability. A history whose words all go undiscounted
    gives up one part in count + 1.
    """
    rows, cut, distinct, place = _gathered(table)
    kept, used = (np.bincount(place, np.concatenate([unpack(r[c], np.float64) for r in rows]), len(distinct)) for c in "ab")
    count = np.zeros(len(distinct))
    count[place] = np.concatenate([unpack(r["c"], np.uint64) for r in rows])
    safe = np.maximum(count, 1)
    full = (count > 0) & (kept >= safe * (1 - 1e-12))
    left = np.where(full, 1 / (safe + 1), 1 - kept / safe)
    weight = np.where(count > 0, np.log10(left) - np.log10(np.maximum(1 - used, 1e-300)), 0.0)
    factor = np.where(full, np.log10(safe / (safe + 1)), 0.0)
    return _answers(rows, [pack(weight[place[s:e]]) for s, e in zip(cut[:-1], cut[1:], strict=True)],
                    [pack(factor[place[s:e]]) for s, e in zip(cut[:-1], cut[1:], strict=True)])


def discounts(tops: list[int]) -> np.ndarray:
    """Katz's Good-Turing factors of counts 0 to LARGEST_DISCOUNTED + 1; the last stands for all larger counts.

    Where counts of counts are too few for a factor between 0 and 1, the count keeps half of its last occurrence.
    """
    k = LARGEST_DISCOUNTED
    out = np.ones(k + 2)
    out[0] = 0.0
    common = (k + 1) * tops[k] / tops[0] if tops[0] else 1.0
    for r in range(1, k + 1):
        raw = (r + 1) * tops[r] / (r * tops[r - 1]) if tops[r - 1] else 1.0
        d = (raw - common) / (1 - common) if common < 1 else 1.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


@dataclass
class Model:
    """The few numbers every task needs; all tables stay distributed."""

    tokens: int
    types: int
    word_discount: np.ndarray
    pair_discount: np.ndarray
    unseen: float
    scale: float

    @staticmethod
    def of(words: list[int], pairs: list[int]) -> "Model":
        n, types, tops = words[0], words[1], words[2:]
        d = discounts(tops)
        r = np.arange(1, LARGEST_DISCOUNTED + 1)
        kept = n - float((np.array(tops[:-1]) * r * (1 - d[1:-1])).sum())
        if not n:
            return Model(0, 0, d, discounts(pairs[2:]), 1.0, 1.0)
        unseen = 1 - kept / n
        scale = 1.0
        if unseen <= 1e-15:
            unseen, scale = 1 / (n + 1), n / (n + 1)
        return Model(n, types, d, discounts(pairs[2:]), unseen, scale)

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        """Of a seen word; the one class of unseen words gets what is left."""
        d = self.word_discount[np.minimum(count, LARGEST_DISCOUNTED + 1)]
        return np.where(count > 0, self.scale * d * count / max(1, self.tokens), self.unseen)

    def pair_mass(self, count: np.ndarray) -> np.ndarray:
        return self.pair_discount[np.minimum(count, LARGEST_DISCOUNTED + 1)] * count


def _answer(replies: list[dict], kind: str, column: str, dtype) -> np.ndarray:
    own = sorted((r for r in replies if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.concatenate([unpack(r[column], dtype) for r in own]) if own else np.empty(0, dtype)


def history_sums(model: Model, buckets: int):
    """Discounted and unigram mass of the pairs a chunk owns, by history."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            chunk, replies = Chunk.read(row), right.to_pylist()
            counts = (_answer(replies, "word", "a", np.uint64) >> np.uint64(1)).astype(np.int64)
            reply = _answer(replies, "pair", "a", np.uint64)
            _, at = np.unique(chunk.pairs(), return_index=True)
            n = (reply >> np.uint64(1)).astype(np.int64)
            own = ((reply & np.uint64(1)) == 1) & (n > 0)
            at, n = at[own], n[own]
            size = len(chunk.keys)
            kept = np.bincount(chunk.before[at], model.pair_mass(n), size)
            used = np.bincount(chunk.before[at], model.word_probability(counts[chunk.word[at]]), size)
            out.append(requests(row["chunk"], "history", buckets, chunk.keys, a=kept, b=used, c=counts.astype(np.uint64)))
        return pa.Table.from_batches(out)
    return run


def token_scores(model: Model):
    """log10 probabilities of every token, summed by document: the pair if it was seen, else weight and word."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            chunk, replies = Chunk.read(row), right.to_pylist()
            counts = (_answer(replies, "word", "a", np.uint64) >> np.uint64(1)).astype(np.int64)
            reply = (_answer(replies, "pair", "a", np.uint64) >> np.uint64(1)).astype(np.int64)
            weight, factor = _answer(replies, "history", "a", np.float64), _answer(replies, "history", "b", np.float64)
            _, place = np.unique(chunk.pairs(), return_inverse=True)
            n = reply[place]
            c, h = counts[chunk.word], counts[chunk.before]
            seen = np.log10(np.maximum(model.pair_mass(n), 1e-300)) - np.log10(np.maximum(h, 1)) + factor[chunk.before]
            other = weight[chunk.before] + np.log10(model.word_probability(c))
            value = np.where(n > 0, seen, other)
            base = np.log10(c + 1.0) - np.log10(float(model.tokens + model.types + 1))
            starts = np.cumsum(chunk.sizes) - chunk.sizes
            out.append(pa.table([
                pa.array(chunk.doc_ids, pa.int64()), pa.array([split_remainder(i, FOLDS) == HELD_OUT for i in chunk.doc_ids], pa.bool_()),
                pa.array(chunk.sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                pa.array(np.full(len(starts), model.tokens, np.int64)), pa.array(np.add.reduceat(base, starts)),
                pa.array(np.add.reduceat(value, starts)), pa.array(np.add.reduceat((n > 0).astype(np.int64), starts)),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_pairs_seen"]))
        return pa.concat_tables(out)
    return run


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _stats(answers: DataFrame) -> list[int]:
    sums = [F.sum(F.try_element_at("stats", F.lit(i + 1))) for i in range(LARGEST_DISCOUNTED + 3)]
    return [int(v or 0) for v in answers.where("chunk IS NULL").agg(*sums).first()]


def katz_scores(docs: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_pairs_seen, one row per row.

    A Katz model of word pairs and words, counted on all rows outside the held-out fold. Documents are
    kept in chunks. For words, pairs and histories each chunk asks a bucket of the key space about its distinct
    keys; the bucket adds up what all chunks know and answers in the order it was asked. So one
    common word or pair is one key of each chunk, and no task holds more than its chunk or bucket.

    Null and empty texts are the end token alone. Repeated rows count and are scored each. No rows
    give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    chunks = stored(tokenised(docs), "chunks")
    words, tokens = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    word_buckets, pair_buckets = (max(1, -(-n // keys_per_bucket)) for n in (words, tokens))

    def asked(df: DataFrame, answer, label: str) -> tuple[DataFrame, list[int]]:
        result = stored(df.groupBy("bucket").applyInArrow(answer, ANSWER), label)
        stats = _stats(result)  # also ends Spark's hold on the step before
        release(spark)
        return result.where("chunk IS NOT NULL"), stats

    word, word_stats = asked(chunks.mapInArrow(count_words(word_buckets), REQUEST), sum_counts, "words")
    pair, pair_stats = asked(chunks.mapInArrow(count_pairs(pair_buckets), REQUEST), sum_counts, "pairs")
    model = Model.of(word_stats, pair_stats)
    replies = word.union(pair)
    history, _ = asked(
        chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(history_sums(model, word_buckets), REQUEST),
        backoff_weights, "histories")
    replies = replies.union(history)
    schema = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
              "score double, n_pairs_seen bigint")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(token_scores(model), schema)
