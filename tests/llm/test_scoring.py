"""Katz backoff against a plain recursion over Python dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import docs, sentence

from shelfmark.llm import scoring


def brute(rows):
    """(base, score, n_known) by document from dictionaries; also every number of the model."""
    seqs = {i: (t or "").encode().lower().split() + [b" "] for i, t in rows}
    train = {i for i in seqs if zlib.crc32(str(i).encode()) % 7 != 2}
    words, pairs = Counter(), Counter()
    for i in train:
        words.update(seqs[i])
        pairs.update(zip([b" ", *seqs[i][:-1]], seqs[i], strict=True))
    n, v = sum(words.values()), len(words)
    tops = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    dw, dp = scoring.discounts(tops(words)), scoring.discounts(tops(pairs))
    kept = sum(dw[min(c, 6)] * c for c in words.values())
    unseen, scale = 1 - kept / n, 1.0
    if unseen <= 1e-15:
        unseen, scale = 1 / (n + 1), n / (n + 1)
    p1 = lambda w: scale * dw[min(words[w], 6)] * words[w] / n if words[w] else unseen
    after = {}
    for (h, w), c in pairs.items():
        after.setdefault(h, {})[w] = c

    def p2(h, w):
        if h not in after:
            return p1(w)
        mass = sum(dp[min(c, 6)] * c for c in after[h].values())
        total = words[h]
        left, factor = 1 - mass / total, 1.0
        if mass >= total * (1 - 1e-12):
            left, factor = 1 / (total + 1), total / (total + 1)
        if w in after[h]:
            return factor * dp[min(after[h][w], 6)] * after[h][w] / total
        return left / (1 - sum(p1(x) for x in after[h])) * p1(w)

    out = {}
    for i, s in seqs.items():
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in s)
        score = sum(math.log10(p2(h, w)) for h, w in zip([b" ", *s[:-1]], s, strict=True))
        out[i] = (base, score, sum(words[w] > 0 for w in s), len(s), n)
    return out, words, p1, p2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [sentence(rng, rng.randrange(0, 60), 40) for _ in range(120)]
    return list(enumerate(made + [made[0]] * 9 + [None, "", "UPPER upper", "never seen before words"], start=1))


def test_scores_match_brute_force(spark, rows):
    want, *_ = brute(rows)
    for per_bucket in (50, 1_000_000):
        got = scoring.katz_scores(docs(spark, [t for _, t in rows]).repartition(5), per_bucket).collect()
        assert len(got) == len(rows)
        for r in got:
            base, score, known, n, total = want[r.doc_id]
            assert (r.n_known, r.n_tokens, r.train_tokens) == (known, n, total)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_weights_are_normalised(rows):
    _, words, p1, p2 = brute(rows)
    assert math.isclose(sum(p1(w) for w in words) + p1(b"unknown"), 1, rel_tol=1e-9)
    for h in [*list(words)[:20], b"unknown"]:
        assert math.isclose(sum(p2(h, w) for w in words) + p2(h, b"unknown"), 1, rel_tol=1e-9)


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (scoring.unpack_sorted(scoring.pack_sorted(keys)) == keys).all()
    assert (scoring.bucket_of(keys, 7) == np.array([int(k) * 7 >> 64 for k in keys >> np.uint64(32) << np.uint64(32)])).all()
