from collections import Counter

import pytest
from pyspark.sql import functions as F

from bankrec import skew


def hot_frame(spark):
    """A third of the rows under one key, and one key the lookup does not have."""
    rows = [(i, "quente" if i % 3 == 0 else ("sem" if i % 7 == 0 else f"k{i % 50}")) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left = hot_frame(spark)
    right = spark.createDataFrame([("quente", 1), ("k1", 2), ("k1", 3), ("k49", 4)], "k string, v int")
    plain = left.join(right, "k", how)
    spread = skew.join_lookup(left, right, ["k"], how, by="id", min_rows=10)
    assert sorted(map(str, spread.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_split_one_by_one(spark):
    left = hot_frame(spark)
    heavy = skew.heavy_keys(left, ["k"], 100)
    assert {r.k: r._partes for r in heavy.collect()} == {"quente": 10, "sem": 3}
    parts = Counter((r.k, r._parte) for r in skew.add_part(left, ["k"], heavy, "id").collect())
    hot = [n for (k, _), n in parts.items() if k == "quente"]
    assert len(hot) == 10 and max(hot) < 150
    assert all(p == 0 for (k, p) in parts if k.startswith("k"))


def test_the_limit_does_not_grow_with_the_table(spark):
    """Ten times the rows make the same key heavy, in ten times the parts."""
    assert skew.heavy_keys(hot_frame(spark), ["k"]).count() == 0
    more = hot_frame(spark).crossJoin(spark.range(10).withColumnRenamed("id", "copia"))
    assert {r.k: r._partes for r in skew.heavy_keys(more, ["k"], 1000).collect()} == {"quente": 10, "sem": 3}


def test_rows_without_key_are_scattered(spark):
    left = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(400)], "id long, k string")
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert skew.join_lookup(left, right, ["k"], "left", by="id", min_rows=10).where("v is null").count() == 200
    tagged = skew.add_part(left, ["k"], skew.heavy_keys(left, ["k"], 10), "id").where("k is null")
    assert tagged.select("_parte").distinct().count() > 150


@pytest.mark.parametrize("min_rows", [1, 100, 10**6])
def test_groups_reach_their_rows(spark, min_rows):
    """Heavy keys by broadcast, the others by shuffle, keys that are null by neither."""
    rows = hot_frame(spark).withColumn("d", F.expr("id % 2")).union(
        spark.createDataFrame([(9000 + i, None, 0) for i in range(50)], "id long, k string, d long"))
    groups = rows.groupBy("d", "k").agg(F.count("*").alias("n"), F.min("id").alias("first"),
                                        F.expr("if(k = 'sem', null, max(id))").alias("last"))
    got = skew.join_groups(rows, groups, ["d", "k"], "n", by="id", min_rows=min_rows)
    want = rows.join(groups, ["d", "k"], "left").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in joined


def test_parts_of_heavy_keys(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 11), ("c", 30)], "k string, n long")
    assert {r.k: r._partes for r in skew.parts_of_heavy_keys(counts, "n", 10).collect()} == {"b": 2, "c": 3}
