"""Many terms in one pass over the texts."""

import random

import pytest
from helpers import pages, values

from shelfmark.operators import audit, search, terms


def words(n, seed):
    rng = random.Random(seed)
    out = ["", "a", "ab", "É", "ß", "straße", "İstanbul", "a b c", None]
    while len(out) < n:
        out.append("".join(rng.choice("abcdeé \U0001f600") for _ in range(rng.randrange(1, 7))))
    return out


def some_texts(seed):
    rng = random.Random(seed)
    return [None, "", "x", "STRASSE straße"] + ["".join(rng.choice("abcdeABé \U0001f600") for _ in range(rng.randrange(60))) for _ in range(40)]


def holds(text, low):
    return text is not None and low is not None and low in text


@pytest.fixture(params=[1, terms.IN_ROW_TERMS])
def limit(request, monkeypatch):
    """Long lists are cut into pieces, short ones tried one by one; both give the same."""
    monkeypatch.setattr(terms, "IN_ROW_TERMS", request.param)


def test_found_and_counted_like_trying_each(spark, limit):
    listed, texts = words(90, 1), some_texts(2)
    rows = [(f"i{i % 30}", t) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "item string, text string").repartition(3)
    table = spark.createDataFrame([(w,) for w in listed + listed[:5]], "term string")
    want = sorted((i, w) for i, t in rows for w in {w for w in listed if w is not None} if holds(t and t.lower(), w.lower()))
    assert sorted(values(audit.deny_list_hits(items, table), "item", "term")) == want
    got = sorted(values(audit.deny_list_verdict(items, table), "item", "denied_terms", "passed"))
    counts = [(i, sum(holds(t and t.lower(), w.lower()) for w in {w for w in listed if w is not None})) for i, t in rows]
    assert got == sorted((i, n, n == 0) for i, n in counts)


def test_unmentioned_like_trying_each(spark, limit):
    listed, texts = words(150, 3), some_texts(4)
    names = spark.createDataFrame([(w,) for w in listed], "name string")
    record = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {w for w in listed if not any(holds(t, w) for t in texts)}
    assert set(values(audit.unmentioned(names, record), "name")) == want


def test_parts_of_a_list_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(terms, "IN_ROW_TERMS", 1)
    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(some_texts(5))], "item string, text string")
    table = spark.createDataFrame([(w,) for w in words(60, 6)], "term string")
    whole = sorted(values(audit.deny_list_verdict(items, table), "item", "denied_terms"))
    packs = terms.packs
    monkeypatch.setattr(terms, "packs", lambda v, c: packs(v, c, 7))
    assert sorted(values(audit.deny_list_verdict(items, table), "item", "denied_terms")) == whole


def listed_terms(spark, n):
    return spark.range(n).selectExpr("concat('term', hex(id * 7919)) AS term")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1_000, 50_000])
def test_one_scan_of_the_text_and_no_exchange(spark, tmp_path, n):
    path = str(tmp_path / "texts")
    spark.createDataFrame([(str(i), f"about term{i:X} and more") for i in range(50)], "item string, text string").write.parquet(path)
    items = spark.read.parquet(path)
    table = listed_terms(spark, n)
    for df in (audit.deny_list_hits(items, table), audit.unmentioned(table.withColumnRenamed("term", "name"), items.select("text")),
               search.search_many(items.selectExpr("cast(item as int) AS doc_id", "0 AS page_index", "text AS full_text"),
                                  table.selectExpr("term AS query_id", "term AS query"))):
        plan = plan_of(df)
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "/texts" in line]
        # The record of ``unmentioned`` is looked at once more for its first row, where an empty name would stand.
        assert 1 <= len(scans) <= 2
        exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
        assert not any("text" in line for line in exchanges)


def test_search_many_folds_like_the_pattern(spark):
    texts = ["İS ıs ſie K Å", "SIE is K å", "µ Μ μ", "ΣΑΣ σας", "ſ", "x"]
    rows = [(i, 0, t, None) for i, t in enumerate(texts)]
    queries = ["is", "sie", "s", "k", "å", "µ", "σας", "i", "x y"]
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = sorted(values(search.search_many(pages(spark, *rows), table), "query_id", "doc_id", "offset"))
    want = sorted((i, d, o) for i, q in enumerate(queries)
                  for d, o in values(search.search_text(pages(spark, *rows), q), "doc_id", "offset"))
    assert got == want
