import random

from pyspark.sql import functions as F

from shelfmark.plans.ranking import with_global_index, with_group_rank
from shelfmark.plans.skew import (
    dimension_join,
    few_against_many,
    hot_keys,
    measured_small,
    salted_lookup,
    split_lookup,
)


def probe(spark):
    random.seed(1)
    rows = [(i, random.choice(["hot"] * 6 + ["a", "b", "zz", None])) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id long, k string")


LOOKUP = [("hot", 1), ("a", 2), ("b", 3), ("unused", 4)]


def test_hot_keys_get_splits_by_their_row_count(spark):
    rows, df = probe(spark)
    n = sum(k == "hot" for _, k in rows)
    found = {r.k: r["__slots"] for r in hot_keys(df, ["k"], task_rows=50).collect()}
    assert found == {"hot": -(-n // 50)}


def test_salted_lookup_equals_a_plain_join(spark):
    _, df = probe(spark)
    lookup = spark.createDataFrame(LOOKUP, "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(str, df.join(lookup, "k", how).select("id", *(["v"] if how in ("left", "inner") else [])).collect()))
        out = salted_lookup(df, lookup, ["k"], ["id"], how, task_rows=10)
        assert sorted(map(str, out.select("id", *(["v"] if "v" in out.columns else [])).collect())) == plain, how


def test_split_lookup_equals_a_plain_join(spark):
    _, df = probe(spark)
    lookup = spark.createDataFrame([x for x in LOOKUP if x[0] != "b"], "k string, v int")
    for how in ("left", "inner"):
        for task_rows in (10, 1000):
            plain = sorted(map(str, df.join(lookup, "k", how).select("id", "v").collect()))
            out = split_lookup(df, lookup, ["k"], how, task_rows=task_rows).select("id", "v").collect()
            assert sorted(map(str, out)) == plain, (how, task_rows)


def test_salted_lookup_spreads_the_hot_key(spark):
    _, df = probe(spark)
    lookup = spark.createDataFrame(LOOKUP, "k string, v int").hint("merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = salted_lookup(df, lookup, ["k"], ["id"], "left", task_rows=10).hint("merge")
        used = out.where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert used > 1


def test_dimension_join_both_ways(spark):
    _, df = probe(spark)
    lookup = spark.createDataFrame(LOOKUP, "k string, v int")
    results = [sorted(map(str, dimension_join(df, lookup, ["k"], ["id"], small=small).select("id", "v").collect()))
               for small in (True, False, None)]
    assert results[0] == results[1] == results[2]


def test_measured_small(spark):
    df = spark.range(100).withColumn("t", F.lit("x" * 50))
    assert measured_small(df)
    assert not measured_small(df, max_rows=99)
    assert not measured_small(df, max_bytes=1000)
    assert measured_small(df.where("id < 0"))


def test_few_against_many(spark):
    many = spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    few = spark.createDataFrame([(1, 3), (2, 3), (3, 77)], "seq long, k long")
    assert sorted(few_against_many(few, many, ["k"], ["seq"]).select("seq", "v").collect()) == [(1, 6), (2, 6)]


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("x", F.pmod(F.hash("id"), F.lit(37)))
    got = with_global_index(df, ["x", "id"], "i").orderBy("i").collect()
    assert [r.i for r in got] == list(range(1000))
    assert [(r.x, r.id) for r in got] == sorted((r.x, r.id) for r in got)


def test_group_rank_of_a_dominant_group(spark):
    df = spark.range(0, 500, 1, 5).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("g"), F.hash("id").alias("o"), "id")
    got = with_group_rank(df, ["g"], ["o", "id"], "rank", ["id"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.o, r.id, r["rank"]))
    for members in groups.values():
        assert [m[2] for m in sorted(members)] == list(range(len(members)))
