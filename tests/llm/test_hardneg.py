"""Hard negatives against a plain loop over all pairs, with ties, zeros, huge components and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, `key` string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.0, "k", 1) for i, v, l in rows], SCHEMA).repartition(3)


def brute(rows, every, positives=5, negatives=3):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        best[i] = min(best.get(i, (label, whole)), (label, whole))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        pairs = [(-score(v, w), i, other) for i, (other, w) in best.items() if i != a and len(w) == len(v)]
        for p, i, _ in sorted(x for x in pairs if x[2] == label)[:positives]:
            fits = sorted(x for x in pairs if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p)
            out += [(a, i, n + 1, j, -p, -q) for n, (q, j, _) in enumerate(fits[:negatives])]
    return sorted(out)


def found(spark, rows, every, **options):
    got = hardneg.mine(table(spark, rows), every, hardneg.relabelled(), **options).collect()
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)


def vectors(n, dims, seed, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(grid)) if grid else (lambda: rng.uniform(-1, 1))
    return [(i, [draw() for _ in range(dims)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_against_all_pairs(spark, block_bytes):
    rows = vectors(300, 6, 1)
    want = brute(rows, 10)
    assert want and found(spark, rows, 10, block_bytes=block_bytes) == want


def test_ties_zeros_and_negative_scores(spark):
    """Few distinct scores: most pairs tie, many positives score zero or less."""
    rows = vectors(200, 3, 2, grid=[0.0, 1.0, -1.0, 0.5])
    want = brute(rows, 5)
    assert any(r[4] == 0 for r in want) and found(spark, rows, 5, block_bytes=2000) == want


def test_common_vector(spark):
    rows = vectors(60, 4, 3) + [(i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(100, 300)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_components_beyond_exact_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 3e6 for _ in range(4)], rng.randrange(3)) for i in range(80)]
    want = brute(rows, 4)
    assert max(abs(r[4]) for r in want) > 1 << 53 and found(spark, rows, 4) == want
    huge = [(i, [1e30 * (i + 1)], i % 2) for i in range(1, 40)]
    assert all(abs(r[4]) < 1 << 63 for r in found(spark, huge, 4))


def test_odd_rows(spark):
    rows = vectors(60, 3, 5) + [
        (None, [1.0, 1.0, 1.0], 1), (70, None, 1), (80, [], 1), (90, [1.0, None, 1.0], 1), (100, [1.0, 2.0, float("nan")], 2),
        (110, [float("inf"), 1.0, 1.0], 2), (120, [1.0, 1.0, 1.0], None), (130, [1.0, 1.0], 1), (132, [1.0, 1.0], 1), (133, [0.8, 0.8], 2),
        (20, [0.5, 0.5, 0.5], 3), (20, [0.5, 0.5, 0.5], 3), (33, [0.1, 0.9, 0.1], 0), (81, [], 2), (82, [], 1)]
    assert found(spark, rows, 10) == brute(rows, 10)
    assert found(spark, [], 10) == [] and found(spark, [(50, [1.0], 1)], 50) == []


def test_packed_keys_sort_and_return():
    rng = random.Random(6)
    edge = [0, 1, -1, (1 << 63) - 1, -(1 << 63) + 1]
    rows = [(rng.choice(edge), rng.choice(edge), rng.randrange(2), rng.choice(edge)) for _ in range(200)]
    a, s, k, i = (np.array(c) for c in zip(*rows, strict=True))
    keys = hardneg.pack(a, s, k, i)
    back = list(hardneg.unpack(sorted(keys)))
    assert back == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_packed_column(spark):
    rows = [(1, -5, 7), (-1, 9, -3), (0, 0, 0), (1 << 40, -(1 << 62), 3)]
    got = spark.createDataFrame(rows, "a bigint, s bigint, i bigint").select(hardneg.packed_key("a", "s", 0, "i").alias("k")).collect()
    a, s, i = (np.array(c) for c in zip(*rows, strict=True))
    assert Counter(bytes(r.k) for r in got) == Counter(hardneg.pack(a, s, 0, i))
