"""Held-out accuracy of co-training, and what the second view adds."""

import random

import numpy as np
from samples import docs, labels, sentence

from shelfmark.llm import quality
from shelfmark.llm.common import split_remainder


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    texts, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        words = sentence(rng, rng.randrange(20, 60)).split()
        texts.append(" ".join(words) if good else " ".join(w + "###" for w in words))
        marks.append((i + 1, int(good), 0))
    got = {r.doc_id: r for r in quality.score_quality(docs(spark, texts), labels(spark, marks[:200])).collect()}
    held = [(got[i], q) for i, q, _ in marks if split_remainder(i, 5) == 0]
    assert held and all(r.held_out for r, _ in held)
    assert sum(r.keep == bool(q) for r, q in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and 0 <= r.content_score <= 1 and 0 <= r.metadata_score <= 1 for r, _ in held)


def test_pseudo_labels_teach_the_other_view():
    """The metadata view sees no label that separates, but learns from the text view's confident rows."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    x = np.c_[np.ones(2000), (2 * y - 1) * 3 + rng.normal(size=2000) * 0.3]
    m = np.c_[np.ones(2000), (2 * y - 1) + rng.normal(size=2000) * 0.8]
    known = np.zeros(2000, bool)
    known[:20] = True
    check = np.zeros(2000, bool)
    check[20:60] = True
    alone, both = (quality.co_train(x, m, y, known, check, rounds=n) for n in (0, 5))
    loss = lambda v: -np.log(np.where(y == 1, v.score(x, m)[1], 1 - v.score(x, m)[1])).mean()
    assert loss(both) <= loss(alone) + 0.02
    assert (both.score(x, m)[2].round() == y).mean() > 0.98


def test_a_capped_sample_keeps_the_labels_share(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED_ROWS", 40)
    rng = random.Random(11)
    texts = [sentence(rng, 40) for _ in range(400)]
    marks = [(i + 1, int(i % 8 > 0), 0) for i in range(400)]
    got = quality.score_quality(docs(spark, texts), labels(spark, marks)).collect()
    assert np.mean([r.score for r in got]) > 0.75


def test_the_pool_is_summed_like_one_table(spark, monkeypatch):
    """``train`` over Spark's sums against the same rounds in one process, with rows of all kinds."""
    rng = random.Random(3)
    texts = [None, ""] + [sentence(rng, 30) if i % 2 else sentence(rng, 30).replace(" ", "### ") for i in range(500)]
    marks = [(i, int(i % 2 == 0), 0) for i in range(3, 120)]
    table = docs(spark, texts).repartition(5)
    rows = quality.features(table)
    got = quality.train(rows, labels(spark, marks))
    known = {i: q for i, q, _ in marks if split_remainder(i, quality.FOLDS) != quality.HELD_OUT}
    held = sorted((r.doc_id, r.features) for r in rows.collect() if split_remainder(r.doc_id, quality.FOLDS) != quality.HELD_OUT)
    x, m = quality._views(np.array([f for _, f in held]))
    y = np.array([known.get(i, 0) for i, _ in held])
    labelled = np.array([i in known for i, _ in held])
    check = labelled & np.array([split_remainder(i, 7) < 2 for i, _ in held])
    want = quality.co_train(x, m, y, labelled & ~check, check)
    for a, b in ((got.content, want.content), (got.metadata, want.metadata), (got.scale, want.scale), (got.combine, want.combine)):
        assert np.allclose(a, b, atol=1e-6)
    alone = quality.co_train(x, m, y, labelled & ~check, check, rounds=0)
    assert not np.allclose(want.content, alone.content, atol=1e-3)  # the pool took part


def test_bounds_take_the_surest_first():
    counts = np.zeros(quality.BINS)
    counts[[10, 100, 500]] = 7, 5, 2
    step = (30 - quality.LEAST) / quality.BINS
    assert [round((quality._bound(counts, n) - quality.LEAST) / step) for n in (1, 2, 3, 7, 8)] == [500, 500, 100, 100, 10]
    assert quality._bound(counts, 0) == np.inf and quality._bound(counts * 0, 5) == np.inf
    assert quality._bound(counts, 100) == quality.LEAST
