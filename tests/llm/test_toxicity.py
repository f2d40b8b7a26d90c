"""The chain's messages against all tag sequences, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from samples import docs, labels, sentence

from shelfmark.llm import toxicity
from shelfmark.llm.common import split_remainder


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_marginals_match_enumeration(lanes):
    rng = np.random.default_rng(1)
    sizes = [1, 5, 7, 2]
    emission = rng.normal(size=sum(sizes))
    first = np.zeros(len(emission), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    step, start = np.array([[0.0, 0.3], [-0.2, 1.7]]), -0.4
    forward, backward = toxicity.messages(emission, first, step, start, lanes)
    p = toxicity.marginals(emission, first, step, start, lanes)
    pair = toxicity.pair_marginals(emission, step, forward, backward)
    at = 0
    for n in sizes:
        total, one, both = 0.0, np.zeros(n), np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            score = start * tags[0] + sum(emission[at + t] * y for t, y in enumerate(tags))
            score += sum(step[a, b] for a, b in itertools.pairwise(tags))
            weight = np.exp(score)
            total += weight
            one += weight * np.array(tags)
            both[1:] += weight * np.array([a * b for a, b in itertools.pairwise(tags)])
        assert np.allclose(p[at:at + n], one / total, rtol=1e-9)
        assert np.allclose(pair[at + 1:at + n], both[1:] / total, rtol=1e-9)
        at += n


def test_held_out_accuracy_and_spans(spark):
    rng = random.Random(8)
    bad = ["grotty", "vexsome", "foulish"]
    texts, marks = [], []
    for i in range(300):
        words = sentence(rng, rng.randrange(20, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + "!")
        texts.append(" ".join(words))
        marks.append((i + 1, 1, int(toxic)))
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, texts), labels(spark, marks)).collect()}
    held = [(got[i], t) for i, _, t in marks if split_remainder(i, 5) == 0]
    assert held and all(r.held_out for r, _ in held)
    assert sum(r.predicted == t for r, t in held) >= 0.97 * len(held)
    for r, t in held:
        for s in r.spans:
            assert {w.strip("!") for w in texts[r.doc_id - 1][s.start:s.end].lower().split()} <= set(bad)


def test_spans_are_code_points():
    data = "é über bad! bad ok".encode()
    assert toxicity.spans(data, np.array([0, 0, 0.9, 0.8, 0.1])) == [{"start": 7, "end": 15}]


def test_gradient_matches_enumeration_and_sums_over_rows(spark):
    """Expected counts over all tag sequences of each text, and the same from Spark tasks."""
    rng = np.random.default_rng(3)
    theta = np.array([-1.0, 0.7, 0.2, -0.4, 1.1, -0.6])  # other, toxic word, two common ones, stay, start
    texts = [(rng.integers(0, 4, n), t) for n, t in ((5, 1), (1, 0), (6, 0), (0, 1), (4, 1))]
    expected = np.zeros(6)
    for ids, toxic in texts:
        if not len(ids):
            continue
        y = (ids == 1) & (toxic == 1)
        total, sums = 0.0, np.zeros(6)
        for tags in itertools.product((0, 1), repeat=len(ids)):
            t = np.array(tags)
            f = np.r_[np.bincount(ids, t, 4), (t[1:] * t[:-1]).sum(), t[0]]
            weight = np.exp(f @ theta)
            total, sums = total + weight, sums + weight * f
        expected += np.r_[np.bincount(ids, y, 4), (y[1:] * y[:-1]).sum(), y[0]] - sums / total
    words = [b"other", b"bad", b"one", b"two"]
    sample = spark.createDataFrame(
        [(bytearray(b" ".join(words[i] for i in ids)), t) for ids, t in texts], "data binary, toxic int").repartition(3)
    got = toxicity.summed_gradient(toxicity.coded(sample, [b"bad"], [b"one", b"two"]), 1, theta)
    assert np.allclose(got, expected, rtol=1e-9, atol=1e-9)


def test_words_of_any_length_and_place_are_learned(spark):
    """A toxic word of 90 bytes behind three hundred clean ones, in whole texts."""
    rng = random.Random(9)
    bad, texts, marks = "vile" * 22 + "st", [], []
    for i in range(200):
        words = sentence(rng, 300).split() + ([bad] if i % 3 == 0 else []) + sentence(rng, 5).split()
        texts.append(" ".join(words))
        marks.append((i + 1, 1, int(i % 3 == 0)))
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, texts), labels(spark, marks)).collect()}
    assert all(got[i].predicted == t for i, _, t in marks)
    assert all(texts[i - 1][s.start:s.end] == bad for i, _, t in marks for s in got[i].spans)
