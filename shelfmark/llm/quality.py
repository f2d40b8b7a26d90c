"""Document quality by co-training a text classifier and a metadata classifier."""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import remainder, slices, small_batches, split_remainder, stored, text_bytes
from shelfmark.llm.toxicity import fit_logistic

FOLDS = 5
HELD_OUT = 0
LABELLED_ROWS = 3_000
ROUNDS = 5
CONFIDENT_SHARE = 0.05
CONFIDENT = 0.9
LEAST = float(np.log(CONFIDENT / (1 - CONFIDENT)))
BINS = 512
STEPS = 4
BUCKETS = 32
SLICE_BYTES = 8 << 20

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOP = b".,;:!?'\"()-"
_MARKS = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGIT + _STOP)
_WIDE = bytes(range(128, 256))


def content_features(text: bytes) -> list[float]:
    """Shares and shapes of the whole text; nothing here reads the metadata."""
    words = text.lower().split()
    n, size = len(words), len(text)
    if not n:
        return [1.0, 1.0] + [0.0] * 13
    without = lambda chars: size - len(text.translate(None, chars))
    lines = text.split(b"\n")
    ends = sum(w[-1] in b"!*#$%&|" for w in words)
    return [
        1.0, 0.0,
        np.log1p(n) / 10,
        len(set(words)) / n,
        sum(map(len, words)) / n / 10,
        max(map(len, words)) / 100,
        without(_UPPER) / size,
        without(_DIGIT) / size,
        10 * without(_MARKS) / size,
        10 * without(_STOP) / size,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        ends / n,
        10 * sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        without(_WIDE) / size,
    ]


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Language, source and recorded length; nothing here reads the text."""
    out = [0.0] * (2 * BUCKETS)
    for k, v in enumerate((lang, source)):
        out[k * BUCKETS + xxhash.xxh3_64_intdigest(b"" if v is None else v.encode()) % BUCKETS] = 1.0
    size = float(np.log1p(max(0, n_chars or 0)))
    return [1.0, float(n_chars is None), size / 10, (size / 10) ** 2, float(size < 4), float(size > 9), *out]


CONTENT, DENSE, METADATA = 15, 6, 6 + 2 * BUCKETS


@dataclass
class Views:
    """Weights of the two views, their calibration (slope, shift) and the combining model."""

    content: np.ndarray
    metadata: np.ndarray
    scale: np.ndarray
    combine: np.ndarray

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.scale[0, 0] * np.clip(x @ self.content, -30, 30) + self.scale[0, 1]
        b = self.scale[1, 0] * np.clip(m @ self.metadata, -30, 30) + self.scale[1, 1]
        both = np.c_[np.ones(len(a)), a, b] @ self.combine
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(views, weights, k: int) -> np.ndarray:
    return np.clip(views[k] @ weights[k], -30, 30)


def pseudo_labels(views, history) -> list[np.ndarray]:
    """The labels each view has been given by the other in the rounds so far (NaN: none); the first one stays.

    A round is the weights it began with and, for each view, the least logit for either label.
    """
    labels = [np.full(len(views[0]), np.nan) for _ in views]
    for weights, bounds in history:
        for k in (0, 1):
            z, given = _logit(views, weights, k), labels[1 - k]
            free = np.isnan(given)
            for value, sure, least in ((1.0, z, bounds[k][0]), (0.0, -z, bounds[k][1])):
                given[free & (sure >= least)] = value
    return labels


def confident(views, history, weights) -> np.ndarray:
    """Rows by view, label and bin of sureness among those the other view has no label for, then the number of rows."""
    labels, counts = pseudo_labels(views, history), []
    for k in (0, 1):
        z = _logit(views, weights, k)[np.isnan(labels[1 - k])]
        for sure in (z, -z):
            sure = sure[sure >= LEAST]
            at = np.minimum((sure - LEAST) / (30 - LEAST) * BINS, BINS - 1).astype(int)
            counts.append(np.bincount(at, minlength=BINS))
    return np.concatenate([*counts, [len(views[0])]]).astype(float)


def _bound(counts: np.ndarray, room: float) -> float:
    """The least logit of the surest bins that hold ``room`` rows, or all; rows of one bin go together."""
    above = np.cumsum(counts[::-1])
    if room <= 0 or above[-1] == 0:
        return np.inf
    return LEAST + (BINS - 1 - min(int(np.searchsorted(above, room)), BINS - 1)) / BINS * (30 - LEAST)


def _slopes(x, y, weight, w) -> np.ndarray:
    """Gradient and Hessian of the log-likelihood, as one row of numbers that may be added."""
    q = _sigmoid(x @ w)
    return np.r_[x.T @ (weight * (y - q)), ((x * (weight * q * (1 - q))[:, None]).T @ x).ravel()]


def pool_slopes(views, history, weights) -> np.ndarray:
    """``_slopes`` of both views over the rows that bear a label of the other view."""
    out = []
    for view, label, w in zip(views, pseudo_labels(views, history), weights, strict=True):
        has = ~np.isnan(label)
        out.append(_slopes(view[has], label[has], np.ones(has.sum()), w))
    return np.concatenate(out)


def co_train(x, m, y, known, check, rounds: int = ROUNDS, weight=None, pool_sum=None, pool_weight: float = 1.0) -> Views:
    """Fit both views on the labelled rows; in each round a view labels its most confident rows for the other.

    ``known`` marks labelled rows for fitting, ``check`` labelled rows kept for calibration; ``weight`` of the rows
    (1 by default) counts in every fit and in the classes' known proportion. All other rows are the pool, unless
    ``pool_sum`` adds a function of two views over a pool of any size, whose rows weigh ``pool_weight``. A view
    hands over those with a probability of at least ``CONFIDENT`` for a class, the surest first, about ``CONFIDENT_SHARE``
    of the pool in a round and in the known proportion; rows that are equally sure go together. The pool is only ever
    summed: into counts by sureness, which give the bounds, and into the slopes of Newton steps.
    """
    weight = np.ones(len(y)) if weight is None else weight
    views = [x, m]
    if pool_sum is None:
        rest = [v[~known & ~check] for v in views]
        pool_sum = lambda of, *args: of(rest, *args)
    good = np.average(y[known], weights=weight[known]) if known.any() else 0.5
    target = y[known].astype(float)
    weights = [fit_logistic(v[known], target, weight[known], prior=1.0) for v in views]
    history = []
    for _ in range(rounds if known.any() else 0):
        counts = pool_sum(confident, history, weights)
        room, counts = CONFIDENT_SHARE * counts[-1], counts[:-1].reshape(2, 2, BINS)
        bounds = [(_bound(c[0], room * good), _bound(c[1], room * (1 - good))) for c in counts]
        history.append(([w.copy() for w in weights], bounds))
        for _ in range(STEPS):
            slopes, start, moved = pool_weight * pool_sum(pool_slopes, history, weights), 0, 0.0
            for k, v in enumerate(views):
                n = v.shape[1]
                own = slopes[start:start + n + n * n] + _slopes(v[known], target, weight[known], weights[k])
                start += n + n * n
                move = np.linalg.solve(own[n:].reshape(n, n) + np.eye(n), own[:n] - weights[k])
                weights[k] = weights[k] + np.clip(move, -5, 5)
                moved = max(moved, np.abs(move).max())
            if moved < 1e-5:
                break
    rows = check if check.sum() >= 20 else known
    scale = np.array([[1.0, 0.0], [1.0, 0.0]])
    for k in (0, 1):
        z = np.clip(views[k][rows] @ weights[k], -30, 30)
        w = fit_logistic(np.c_[z, np.ones(len(z))], y[rows].astype(float), weight[rows], prior=0.1)
        if len(z):
            scale[k] = w
    model = Views(weights[0], weights[1], scale, np.array([0.0, 1.0, 1.0]))
    a = scale[0, 0] * np.clip(x[rows] @ weights[0], -30, 30) + scale[0, 1]
    b = scale[1, 0] * np.clip(m[rows] @ weights[1], -30, 30) + scale[1, 1]
    if len(a):
        model.combine = fit_logistic(np.c_[np.ones(len(a)), a, b], y[rows].astype(float), weight[rows], prior=0.1)
    return model


def _compact(part: pa.RecordBatch) -> pa.Array:
    """Both views of each row as one list: the one-hot parts of the metadata as two numbers."""
    x = np.array([content_features(d) for d in part.column("data").to_pylist()]).reshape(-1, CONTENT)
    m = [metadata_features(*row) for row in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
    m = np.array(m).reshape(-1, METADATA)
    hot = [m[:, i:i + BUCKETS].argmax(axis=1) for i in (DENSE, DENSE + BUCKETS)]
    f = np.c_[x, m[:, :DENSE], np.stack(hot, axis=1)]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * f.shape[1], pa.int32()), pa.array(f.ravel()))


def _views(features: np.ndarray) -> list[np.ndarray]:
    f = features.reshape(-1, CONTENT + DENSE + 2)
    m = np.zeros((len(f), METADATA))
    m[:, :DENSE] = f[:, CONTENT:CONTENT + DENSE]
    for k in (0, 1):
        m[np.arange(len(f)), DENSE + k * BUCKETS + f[:, CONTENT + DENSE + k].astype(int)] = 1.0
    return [f[:, :CONTENT], m]


def _of_batch(part: pa.RecordBatch) -> list[np.ndarray]:
    return _views(part.column("features").flatten().to_numpy(zero_copy_only=False))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, features): both views of every row, computed once from whole texts and stored."""
    small_batches(docs.sparkSession)
    inputs = docs.select(
        F.col("doc_id").cast("bigint"), text_bytes().alias("data"), F.col("lang").cast("string"),
        F.col("source").cast("string"), F.col("n_chars").cast("bigint"))

    def run(batches):
        for part in slices(batches, "data", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _compact(part)], ["doc_id", "features"])

    return stored(inputs.mapInArrow(run, "doc_id bigint, features array<double>"), "quality-features")


def summed(rows: DataFrame, of, *args) -> np.ndarray:
    """The sum of ``of(views, *args)`` over all rows; a task hands on one list of numbers, Spark adds them."""
    def run(batches):
        total = of(_views(np.zeros(0)), *args)
        for part in batches:
            total = total + of(_of_batch(part), *args)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    added = rows.select("features").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v"))
    got = added.groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(len(got)) if got else of(_views(np.zeros(0)), *args)
    for r in got:
        total[r["at"]] = r["v"]
    return total


def train(rows: DataFrame, labels: DataFrame) -> Views:
    """Fit on at most ``LABELLED_ROWS`` labelled ids of each label and on all unlabelled rows of ``features``.

    Labelled ids are taken by the smallest hashes, so a rerun takes the same. Ids of the held-out fold
    and rows without an id are in neither part. Labels other than 0 and 1 are not used; an id with both counts as 0.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(remainder("doc_id", FOLDS) != HELD_OUT)
    known = stored(known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality")), "quality-labels")
    picked = [known.where(F.col("quality") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS) for v in (0, 1)]
    chosen = rows.join(F.broadcast(reduce(DataFrame.union, picked)), "doc_id")
    # Equal rows are counted, so an id that many rows share comes to the driver once.
    few = chosen.groupBy("doc_id", "features", "quality").agg(F.count(F.lit(1)).alias("n")).collect()
    few.sort(key=lambda r: (r.doc_id, r.features))
    mine = F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT)
    pool = stored(rows.where(mine).join(known.select("doc_id"), "doc_id", "left_anti").select("features"), "quality-pool")
    x, m = _views(np.array([r.features for r in few], float))
    y = np.array([r.quality for r in few], int)
    check = np.array([split_remainder(r.doc_id, 7) for r in few], int) < 2
    # The sample has as many rows of either label as there are; weights give back their share among all labelled
    # ids. An unlabelled row weighs what a labelled one would without the sample, so all sizes of table fit alike.
    count = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    scale = {v: n / min(n, LABELLED_ROWS) for v, n in count.items()}
    mean = sum(count.values()) / max(1, sum(min(n, LABELLED_ROWS) for n in count.values()))
    weight = np.array([scale[r.quality] / mean * r.n for r in few], float)
    return co_train(x, m, y, ~check, check, weight=weight, pool_sum=lambda of, *args: summed(pool, of, *args),
                    pool_weight=1 / mean if mean else 1.0)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, content_score, metadata_score, score and keep, one row per row of ``docs``.

    Scores are probabilities of label 1, from the whole text, from the metadata, and from both after
    calibration; ``keep`` is score >= 0.5. Null and empty texts and null metadata are features of their own;
    repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    Without labels every score is one half.
    """
    rows = features(docs)
    views = train(rows, labels)
    schema = ("doc_id bigint, held_out boolean, content_score double, metadata_score double, score double, keep boolean")

    def run(batches):
        for part in batches:
            ids = part.column("doc_id").to_pylist()
            a, b, both = views.score(*_of_batch(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([split_remainder(i, FOLDS) == HELD_OUT for i in ids], pa.bool_()), pa.array(a),
                 pa.array(b), pa.array(both), pa.array(both >= 0.5)],
                ["doc_id", "held_out", "content_score", "metadata_score", "score", "keep"])

    return rows.mapInArrow(run, schema)
