"""Near copies against all pairs of sets."""

import random

import numpy as np
from samples import docs, sentence

from shelfmark.llm import neardup


def sets_of(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(rows, width):
    sets = {i: sets_of(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(11)
    out = []
    for g in range(12):
        words = sentence(rng, rng.choice([3, 8, 40, 200])).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10_000)}"
            out.append(" ".join(copy))
    # A chain: each is near the next, the ends are not near each other.
    chain = sentence(rng, 150, 100_000).split()
    for k in range(12):
        out.append(" ".join(chain[k * 6:] + [f"c{j}" for j in range(k * 6)]))
    rng.shuffle(out)
    return list(enumerate([*out, None, "", "alone", "ALONE", "two words", "two  WORDS"], start=1))


def test_components_match_all_pairs(spark):
    rows = corpus()
    for width in (2, 5):
        want = brute(rows, width)
        got = neardup.linked(docs(spark, [t for _, t in rows]).repartition(4), width).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowded_buckets_in_blocks(spark, monkeypatch):
    """Copies of one text with many changes: most pairs lie just below or above the threshold."""
    for name, value in (("DENSE_BUCKET", 3), ("BLOCK_SETS", 8), ("MATRIX_COLUMNS", 64)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(9)
    words, texts = sentence(rng, 120, 10_000).split(), []
    for _ in range(70):
        copy = list(words)
        for _ in range(rng.randrange(0, 16)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts, start=1))
    got = neardup.linked(docs(spark, texts).repartition(4), 2).collect()
    want = brute(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < 60


def test_rows_with_one_id_tie_their_texts(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 50), sentence(rng, 50)
    got = neardup.linked(docs(spark, [(5, a), (9, b), (7, a), (7, b)]), 2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 5)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    other = np.unique(np.r_[base[:900], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    a, b = neardup.signatures([np.unique(base), other])
    assert abs((a == b).mean() - 900 / 1100) < 0.12
    assert (neardup.signatures([np.unique(base)])[0] == a).all()
    one = neardup.signatures([base[:1]])[0]
    assert sorted((one >> 40).tolist()) == list(range(neardup.PLACES))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a bigint, b bigint").repartition(6)
    got = {r.a: r.b for r in neardup.components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}
