"""Exact duplicates against grouping by the text itself, with blocks, digests and odd rows that try to collide."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from samples import docs, empty, odd, odd_rows, sentence

from shelfmark.llm import exactdup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = False
        for i in known + [None] * (len(ids) - len(known)):
            out.append((i, keep, len(ids), not kept, sha))
            kept = True
    return sorted(out, key=str)


def found(df, **options):
    rows = exactdup.exact_groups(df, **options).collect()
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows], key=str)


def texts_like():
    """Texts that share beginnings, ends, blocks and lengths, and copies that differ in blanks only."""
    rng = random.Random(2)
    base = [sentence(rng, n) for n in (1, 2, 3, 10, 40, 41, 200)]
    texts = base + [b + " " for b in base] + [b.replace(" ", "\n\t ") for b in base] + [b[::-1] for b in base]
    texts += ["ab" * n for n in range(1, 40)] + ["ba" * n for n in range(1, 40)] + ["é" * 9, "é" * 9, "", None, " ", " "]
    texts += [rng.choice(base) for _ in range(100)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [60, 4096])
def test_against_grouping_by_text(spark, size):
    texts = texts_like()
    rows = docs(spark, texts).repartition(4)
    assert found(rows, size=size) == brute(list(enumerate(texts, start=1)))


def test_blocks_that_share_a_digest(spark):
    """With two digests for all blocks every name has to come from the bytes."""
    texts = texts_like()
    weak = F.when(F.substring(F.md5("block"), 1, 1) < "8", F.lit("low")).otherwise(F.lit("high"))
    assert found(docs(spark, texts).repartition(3), size=80, digest=weak) == brute(list(enumerate(texts, start=1)))


def test_odd_rows(spark):
    assert found(odd(spark)) == brute([r[:2] for r in odd_rows()])
    assert exactdup.exact_groups(empty(spark)).count() == 0


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    rows = docs(spark, [(5, "a b"), (5, "a  b"), (None, "a b"), (None, "c"), (None, "c"), (3, "d"), (3, "e")])
    got = found(rows)
    assert got == brute([(5, "a b"), (5, "a b"), (None, "a b"), (None, "c"), (None, "c"), (3, "d"), (3, "e")])
    assert sum(kept for *_, kept, _ in got) == 4


def test_names_follow_the_order_of_their_values(spark):
    values = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("v"))
    rows = exactdup.sorted_names(values, ["v"]).orderBy("name").collect()
    assert [r.v for r in rows] == sorted(r.v for r in rows) and len({r.name for r in rows}) == 1000


def test_plan_has_no_python(spark):
    plan = exactdup.named_blocks(docs(spark, ["a", "b"]), 4, F.md5("block"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
