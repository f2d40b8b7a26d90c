"""Toxic spans by a linear-chain conditional random field; document scores from its marginals."""

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import remainder, slices, small_batches, split_remainder, stored, text_bytes
from shelfmark.plans.skew import measured_small

FOLDS = 5
HELD_OUT = 0
SAMPLE_ROWS = 1_500
CHAIN_ROUNDS = 40
MIN_DOCS = 4
MIN_LOG_ODDS = 1.5
MIN_SHARE = 1 / 20_000
COMMON_SHARE = 0.02
PENDING_WORDS = 500_000
PENDING_BYTES = 64 << 20
SLICE_BYTES = 1 << 20
LANES = 512
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TRIM = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: bytes) -> list[bytes]:
    """Blank-separated words, lower-cased, without punctuation at their ends."""
    return [w.strip(_TRIM) for w in text.translate(_LOWER).split()]


def word_odds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, docs, bad, log_odds): a lower bound of how much likelier a word's documents are labelled toxic.

    All labelled training rows are counted; a word counts once for each document. The bound lies two
    standard errors below the log-odds.
    """
    def batch(counted):
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in counted], pa.binary()), pa.array([t for _, t in counted], pa.int32()),
             pa.array(list(counted.values()), pa.int64())], ["word", "toxic", "n"])

    def run(batches):
        counted, size = Counter(), 0
        for part in slices(batches, "data", SLICE_BYTES):
            for data, toxic in zip(part.column("data").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                counted.update((w, toxic) for w in set(tokens(data)) if w)
            size += part.nbytes
            if len(counted) > PENDING_WORDS or size > PENDING_BYTES:
                yield batch(counted)
                counted, size = Counter(), 0
        yield batch(counted)

    total = labels.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    counted = docs.join(F.broadcast(labels) if measured_small(labels) else labels, "doc_id").select(
        text_bytes().alias("data"), "toxic").mapInArrow(run, "word binary, toxic int, n bigint")
    bad, fine = (F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("n"))), F.lit(0)) for t in (1, 0))
    b, f = F.col("bad") + 0.5, F.col("fine") + 0.5
    return counted.groupBy("word").agg(bad.alias("bad"), fine.alias("fine")).select(
        "word", (F.col("bad") + F.col("fine")).alias("docs"), "bad",
        (F.log(b / (total[0] + 1.0)) - F.log(f / (total[1] + 1.0)) - 2 * F.sqrt(1 / b + 1 / f)).alias("log_odds"),
    )


@dataclass
class Field:
    """A two-tag chain: word potentials for tag 1 against tag 0, transition and start log-odds."""

    words: dict[bytes, float]
    other: float
    step: np.ndarray
    start: float
    calibration: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        get, other = self.words.get, self.other
        return np.array([get(w, other) for w in words])

    def probabilities(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = np.array([document_features(p) for p in marginals]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


def messages(emission: np.ndarray, first: np.ndarray, step: np.ndarray, start: float, lanes: int = LANES):
    """Forward and backward ratios (tag 1 to tag 0) of many texts laid end to end; ``first`` marks their starts.

    With two tags a message is one number. The stream is cut into lanes that are walked together; the
    ratio that enters a lane is what left the one before, and the walk is repeated until these
    agree, so the cut does not change the result.
    """
    n = len(emission)
    width = max(1, -(-n // lanes))
    pad = width * lanes - n
    shaped = lambda x: x.reshape(lanes, width).T.copy()
    starts = np.pad(first, (0, pad), constant_values=True)
    e, begins, ends = shaped(np.exp(np.pad(emission, (0, pad)))), shaped(starts), shaped(np.roll(starts, -1))
    m00, m01, m10, m11 = np.exp(step).ravel()
    s = np.exp(start)
    forward, backward = np.empty_like(e), np.empty_like(e)
    enter = np.full(lanes, s)
    while True:
        r = enter
        for t in range(width):
            r = e[t] * np.where(begins[t], s, (m01 + m11 * r) / (m00 + m10 * r))
            forward[t] = r
        known = np.concatenate([[s], r[:-1]])
        if np.allclose(known, enter, rtol=1e-12, atol=0):
            break
        enter = known
    leave = np.ones(lanes)
    while True:
        b = leave
        for t in range(width - 1, -1, -1):
            b = np.where(ends[t], 1.0, b)
            backward[t] = b
            x = e[t] * b
            b = (m10 + m11 * x) / (m00 + m01 * x)
        known = np.concatenate([b[1:], [1.0]])
        if np.allclose(known, leave, rtol=1e-12, atol=0):
            break
        leave = known
    return forward.T.ravel()[:n], backward.T.ravel()[:n]


def marginals(emission: np.ndarray, first: np.ndarray, step: np.ndarray, start: float, lanes: int = LANES) -> np.ndarray:
    """P(tag 1) of every token."""
    forward, backward = messages(emission, first, step, start, lanes)
    odds = forward * backward
    return odds / (1.0 + odds)


def pair_marginals(emission: np.ndarray, step: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """P(tag 1 at a token and at the one before); means nothing where a text starts."""
    m = np.exp(step)
    prior, x = np.roll(forward, 1), np.exp(emission) * backward
    both = m[1, 1] * prior * x
    return both / (m[0, 0] + m[0, 1] * x + m[1, 0] * prior + both)


def chain_gradient(ids: np.ndarray, y: np.ndarray, first: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Observed minus expected counts of texts laid end to end: words, staying in tag 1, starting in tag 1.

    ``ids`` numbers the words (0: any other), ``y`` holds the labelled tags, ``first`` marks starts.
    """
    n = len(theta) - 2
    if not len(ids):
        return np.zeros(n + 2)
    stay, start = theta[n], theta[n + 1]
    emission, table = theta[ids], np.array([[0.0, 0.0], [0.0, stay]])
    forward, backward = messages(emission, first, table, start)
    p = forward * backward / (1 + forward * backward)
    pair = pair_marginals(emission, table, forward, backward)
    return np.concatenate([
        np.bincount(ids, y - p, n), [(y * np.roll(y, 1) - pair)[~first].sum()], [(y - p)[first].sum()]])


def fit_chain(gradient: Callable[[np.ndarray], np.ndarray], vocabulary: list[bytes], rounds: int = CHAIN_ROUNDS) -> Field:
    """Maximum likelihood with a Gaussian prior by gradient steps (Rprop); ``gradient`` sums over all texts.

    Word ``i`` of the vocabulary has number ``i + 1``.
    """
    n = len(vocabulary) + 1
    theta = np.zeros(n + 2)  # words, stay in tag 1, start in tag 1
    theta[:n], theta[n + 1] = -2.0, -2.0
    step, last = np.full(n + 2, 0.3), np.zeros(n + 2)
    for _ in range(rounds):
        grad = gradient(theta) - 0.05 * theta
        same = grad * last
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-3, 1.0)
        theta = np.clip(theta + np.sign(grad) * step, -12, 12)
        last = grad
    return Field({w: float(theta[i + 1]) for i, w in enumerate(vocabulary)}, float(theta[0]),
                 np.array([[0.0, 0.0], [0.0, float(theta[n])]]), float(theta[n + 1]), np.zeros(4))


def coded(sample: DataFrame, lexicon: list[bytes], common: list[bytes]) -> DataFrame:
    """(ids, toxic): the whole texts as 32-bit word numbers, toxic words first, then common ones, 0 for others."""
    number = {w: i + 1 for i, w in enumerate([*lexicon, *common])}

    def run(batches):
        for part in slices(batches, "data", SLICE_BYTES):
            ids = [np.array([number.get(w, 0) for w in tokens(d)], np.int32).tobytes() for d in part.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), part.column("toxic").cast(pa.int32())], ["ids", "toxic"])

    return sample.mapInArrow(run, "ids binary, toxic int")


def summed_gradient(texts: DataFrame, n_toxic: int, theta: np.ndarray) -> np.ndarray:
    """The gradient over coded texts, each task adding up its own; numbers up to ``n_toxic`` are toxic words."""
    def run(batches):
        total = np.zeros(len(theta))
        for part in slices(batches, "ids", SLICE_BYTES):
            rows = [(np.frombuffer(d, np.int32), t) for d, t in zip(
                part.column("ids").to_pylist(), part.column("toxic").to_pylist(), strict=True) if d]
            if rows:
                ids = np.concatenate([d for d, _ in rows])
                marked = np.repeat([t == 1 for _, t in rows], [len(d) for d, _ in rows])
                first = np.zeros(len(ids), bool)
                first[np.cumsum([0] + [len(d) for d, _ in rows[:-1]])] = True
                total += chain_gradient(ids, (marked & (ids > 0) & (ids <= n_toxic)).astype(float), first, theta)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["grad"])

    parts = texts.mapInArrow(run, "grad array<double>").collect()
    return sum((np.array(r.grad) for r in parts), np.zeros(len(theta)))


def document_features(p: np.ndarray) -> list[float]:
    """Constant, log-odds that some token is toxic, expected toxic tokens and their share."""
    if not len(p):
        return [1.0, -10.0, 0.0, 0.0]
    clean = float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
    some = np.clip(np.log(max(-np.expm1(clean), 1e-12)) - clean, -10.0, 10.0)
    total = float(p.sum())
    return [1.0, float(some), float(np.log1p(total)), float(np.log1p(100 * total / len(p)))]


def fit_logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, prior: float = 1e-2, rounds: int = 50
) -> np.ndarray:
    """Newton steps for ridge logistic regression."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(y) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + prior * np.eye(len(w))
        move = np.linalg.solve(hess, x.T @ (weight * (y - q)) - prior * w)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit the field on labelled rows outside the held-out fold.

    Word statistics come from all of these rows and words of any length. The chain and the calibration are fitted on the
    whole texts of at most ``sample_rows`` rows of each label (the smallest hashes of the id), in Spark tasks that add up
    gradients. Labelled tokens: the words of toxic rows that occur in at least ``MIN_DOCS`` rows and ``MIN_SHARE`` of the
    toxic ones with bounded log-odds of at least ``MIN_LOG_ODDS`` are toxic, all others are not. Words in
    ``COMMON_SHARE`` of the labelled rows have weights of their own too; both shares bound the number of words by that of
    a text. Labels other than 0 and 1 are not used; an id labelled both ways counts as toxic.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(remainder("doc_id", FOLDS) != HELD_OUT).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known, "labels")
    share = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    suspect = (
        (F.col("docs") >= MIN_DOCS) & (F.col("log_odds") >= MIN_LOG_ODDS) & (F.col("bad") >= MIN_SHARE * share.get(1, 0)))
    chosen = word_odds(docs, known).select("word", suspect.alias("toxic"), "docs").where(
        F.col("toxic") | (F.col("docs") >= COMMON_SHARE * sum(share.values()))).collect()
    lexicon = sorted(bytes(r.word) for r in chosen if r.toxic)
    common = sorted(bytes(r.word) for r in chosen if not r.toxic)
    few = reduce(DataFrame.union, [
        known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for value in (0, 1)
    ])
    sample = stored(docs.join(F.broadcast(few), "doc_id").select(text_bytes().alias("data"), "toxic"), "sample")
    texts = stored(coded(sample, lexicon, common), "coded")
    field = fit_chain(lambda theta: summed_gradient(texts, len(lexicon), theta), [*lexicon, *common])

    def measure(batches):
        for part in slices(batches, "data", SLICE_BYTES):
            ps = score_texts(field, [tokens(d) for d in part.column("data").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([document_features(p) for p in ps], pa.list_(pa.float64())), part.column("toxic").cast(pa.int32())],
                ["x", "toxic"])

    seen = sorted((tuple(r.x), r.toxic) for r in sample.mapInArrow(measure, "x array<double>, toxic int").collect())
    # The sample has as many rows of either label as there are; weights give back their share among all rows.
    kept = Counter(t for _, t in seen)
    weight = np.array([share[t] / kept[t] for _, t in seen])
    field.calibration = fit_logistic(np.array([x for x, _ in seen]).reshape(-1, 4), np.array([t for _, t in seen], float), weight)
    return field


def score_texts(field: Field, texts: list[list[bytes]]) -> list[np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    emission = np.empty(int(sizes.sum()))
    for t, end, n in zip(texts, ends, sizes, strict=True):
        emission[end - n:end] = field.emissions(t)
    first = np.zeros(len(emission), bool)
    first[(ends - sizes)[sizes > 0]] = True
    p = marginals(emission, first, field.step, field.start)
    return np.split(p, ends[:-1]) if len(texts) else []


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_tokens and spans, one row per row of ``docs``.

    ``score`` is the calibrated probability of label 1 from the marginals of the whole text, ``spans`` the
    code-point ranges (end exclusive) of runs of words with a marginal of at least one half. Only
    the text is an input of the score. Null and empty texts have no tokens and get the score of
    such a text; repeated rows give repeated results; other columns are not read.
    """
    schema = ("doc_id bigint, held_out boolean, score double, predicted int, toxic_tokens double, "
              "spans array<struct<start:int,end:int>>")

    def run(batches):
        for part in slices(batches, "data", SLICE_BYTES):
            data, ids = part.column("data").to_pylist(), part.column("doc_id").to_pylist()
            texts = [tokens(d) for d in data]
            ps = score_texts(field, texts)
            score = field.probabilities(ps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([split_remainder(i, FOLDS) == HELD_OUT for i in ids]),
                 pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                 pa.array([float(p.sum()) for p in ps], pa.float64()),
                 pa.array([spans(d, p) for d, p in zip(data, ps, strict=True)],
                          pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "held_out", "score", "predicted", "toxic_tokens", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("data")).mapInArrow(run, schema)


def spans(data: bytes, p: np.ndarray) -> list[dict]:
    marked = np.flatnonzero(p >= 0.5)
    if not len(marked):
        return []
    at, bounds = 0, []
    wanted = set(marked.tolist())
    for i, w in enumerate(data.split()):
        at = data.index(w, at)
        if i in wanted:
            bounds.append((i, at, at + len(w)))
        at += len(w)
    runs = []
    for i, a, b in bounds:
        if runs and runs[-1][0] == i - 1:
            runs[-1] = (i, runs[-1][1], b)
        else:
            runs.append((i, a, b))
    chars = lambda n: len(data[:n].decode())
    return [{"start": chars(a), "end": chars(b)} for _, a, b in runs]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled training rows and score every document."""
    small_batches(docs.sparkSession)
    return score_documents(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the field does not predict toxic; columns pass unchanged."""
    small_batches(docs.sparkSession)
    field = train(docs, labels)

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            texts = [tokens((t or "").encode()) for t in part.column("text").to_pylist()]
            yield part.filter(pa.array(field.probabilities(score_texts(field, texts)) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
