"""Ranked search against scoring every document, with ties, odd rows, tiny segments and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from samples import docs, empty, odd, odd_rows

from shelfmark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for (doc_id, c), n in zip(counts, sizes, strict=True):
            m = 10 + (90 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in own if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(spark, df, items, **options):
    items = spark.createDataFrame([(i, t, 1, b"x") for i, t in items], "item_id bigint, text string, rank int, term binary")
    rows = ranked.rank_documents(df, items, **options).collect()
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in rows], key=str)


def corpus(n, seed):
    """Zipf-like words, so that some terms are in nearly all documents."""
    rng = random.Random(seed)
    draw = lambda k: " ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(k))
    texts = [draw(rng.randrange(1, 120)) for _ in range(n)]
    return texts + texts[: n // 4], [(i, draw(rng.randrange(1, 25))) for i in range(30)]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 3000, "block": 4}, {"segment_bytes": 1, "query_bytes": 300}])
def test_against_all_documents(spark, options):
    texts, items = corpus(60 if "query_bytes" in options else 400, 1)
    assert found(spark, docs(spark, texts).repartition(3), items, **options) == brute(list(enumerate(texts, start=1)), items)


def test_many_ties_go_to_small_ids(spark):
    texts = ["alpha beta"] * 50 + ["alpha gamma"] * 50 + ["delta"] * 30
    items = [(1, "alpha beta"), (2, "alpha"), (3, "gamma delta"), (4, "missing")]
    assert found(spark, docs(spark, texts).repartition(5), items, block=4, segment_bytes=200) == brute(list(enumerate(texts, start=1)), items)


def test_odd_rows(spark):
    items = [(1, "ONE two größe"), (None, "no id here at all"), (2, None), (3, ""), (4, "tie w1 w2 w3 x"), (5, "1é \U0001f600 end"), (5, "tie")]
    assert found(spark, odd(spark), items) == brute([r[:2] for r in odd_rows()], items)
    assert found(spark, empty(spark), items) == [] and found(spark, odd(spark), []) == []
    assert found(spark, docs(spark, [None, "", " -- "]), items) == []


def test_blocks_round_trip():
    rng = random.Random(3)
    texts = [" ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))).encode() for _ in range(300)]
    (names, block, first, last, n, tops, data), lengths = ranked.segment_blocks(texts, 16)
    got = {}
    for t, b, f, la, k, top, d in zip(*(c.to_pylist() for c in (names, block, first, last, n, tops, data)), strict=True):
        pairs = ranked.decoded(d).reshape(-1, 2)
        at = f + np.cumsum(pairs[:, 0])
        assert len(at) == k and at[-1] == la
        got.setdefault(t, []).extend(zip(at.tolist(), pairs[:, 1].tolist(), strict=True))
        best = max(ranked.contributions(1000, pairs[:, 1], lengths[at], 300, int(lengths.sum())))
        own = np.array(top).reshape(-1, 2)
        assert best == max(ranked.contributions(1000, own[:, 0], own[:, 1], 300, int(lengths.sum())))
    want = {}
    for i, t in enumerate(texts):
        for term, c in Counter(t.split()).items():
            want.setdefault(term, []).append((i, c))
    assert got == want and list(got) == sorted(want)


def test_rejects_candidates_before_decompression():
    """One rare word decides; of the common word's blocks only those of the candidates are opened."""
    texts = [b"common " + (b"rare " * 3 if i in (5, 900) else b"filler " * (i % 7)) for i in range(1000)]
    (names, _, first, last, n, tops, data), lengths = ranked.segment_blocks(texts, 16)
    scorer = ranked.SegmentScorer(np.arange(1000), lengths, 1000, int(lengths.sum()))
    rows = list(zip(*(c.to_pylist() for c in (names, first, last, tops, data)), strict=True))
    for term, weight in ((b"common", 1), (b"rare", 6000)):
        own = [r for r in rows if r[0] == term]
        scorer.load(term, weight, *(list(c) for c in zip(*(r[1:] for r in own), strict=True)))
    heap = [(10**6, 0), (10**6, -1)]
    scorer.search([b"common", b"rare"], heap, 2)
    assert sorted(-i for _, i in heap) == [5, 900]
    assert len(scorer.lists[b"common"].opened) == 2 and len(scorer.lists[b"common"].data) == 63
