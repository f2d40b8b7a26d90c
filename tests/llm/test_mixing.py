"""Targets by plain water filling, and what the sampling promises."""

import random

from samples import docs, sentence

from shelfmark.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, out, open_ = share * sum(sizes.values()), {}, set(order)
    while True:
        level = (budget - sum(out.values())) / max(1e-300, sum(weight[s] for s in open_))
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return {**out, **{s: level * weight[s] for s in open_}}
        out.update({s: 2.0 * sizes[s] for s in full})
        open_ -= full


def corpus(spark, seed=1):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(0, 80)) for _ in range(400)]
    sources = [rng.choice(["a", "a", "a", "a", "b", "B", "é", "z", None]) for _ in texts]
    return docs(spark, texts, sources).repartition(5), texts, sources


def test_targets_and_taken(spark):
    df, texts, sources = corpus(spark)
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    rows = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    taken = dict.fromkeys(sizes, 0)
    for i, (t, s) in enumerate(zip(texts, sources, strict=True), start=1):
        r = rows[i]
        assert r.size == len(t.split()) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    again = {r.doc_id: r for r in mixing.mix_sources(df.repartition(9)).collect()}
    assert again == rows


def test_documents_follow_decisions(spark):
    df, *_ = corpus(spark, 2)
    want = {r.doc_id: r.repeats for r in mixing.mix_sources(df).collect() if r.repeats}
    got = mixing.mix_documents(df)
    assert {r.doc_id: r.repeats for r in got.collect()} == want
    assert got.columns == [*df.columns, "repeats"]


def test_quality_moves_the_draw(spark):
    """Among equal sizes clean documents are drawn more often than symbol-ridden ones."""
    texts = ["word " * 10 if i % 2 else "### " * 10 for i in range(600)]
    rows = docs(spark, texts, ["s"] * 600).select("doc_id", *mixing.sampling_columns()).orderBy("sample_key").collect()
    assert sum(r.doc_id % 2 == 0 for r in rows[:200]) > 150
