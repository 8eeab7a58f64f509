import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagekin.plans import skew


def hot_rows(seed, n=400):
    rng = random.Random(seed)
    return [("hot" if i % 3 else f"k{rng.randrange(20)}", rng.randrange(30), i) for i in range(n)]


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [10, 10_000])
def test_row_number_within_is_exact(spark, keys, limit):
    rows = hot_rows(1)
    df = spark.createDataFrame(rows, "k string, v int, i int")
    found = {r.i: r.no for r in skew.row_number_within(df, keys, ["v", "i"], "no", limit).collect()}
    groups = {}
    for k, v, i in rows:
        groups.setdefault(k if keys else "", []).append((v, i))
    expected = {i: no for group in groups.values() for no, (v, i) in enumerate(sorted(group), 1)}
    assert found == expected


def test_running_total_of_weights(spark):
    rows = hot_rows(2)
    df = spark.createDataFrame([(k, v, i, i % 5) for k, v, i in rows], "k string, v int, i int, w int")
    found = {r.i: r.s for r in skew.running_total_within(df, ["k"], ["v", "i"], "w", "s", 10).collect()}
    for k, v, i in rows:
        assert found[i] == sum(j % 5 for kk, vv, j in rows if kk == k and (vv, j) < (v, i))


def test_slices_with_nulls_first(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", None, 3), ("a", 1, 4)], "k string, v int, i int")
    found = {r.i: r.no for r in skew.row_number_within(df, ["k"], ["v", "i"], "no", 1).collect()}
    assert found == {1: 1, 3: 2, 4: 3, 2: 4}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3)), max_size=40), limit=st.integers(1, 8))
def test_lookup_join_keeps_every_row(spark, data, limit):
    rows = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "k string, v int, i int")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    joined = skew.lookup_join(rows, lookup, ["k"], "n", ["i"], "left", limit).collect()
    assert sorted(r.i for r in joined) == list(range(len(data)))
    assert all(r.total == sum(v for k, v in data if k == r.k) for r in joined)


def test_hot_key_is_spread(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), "id")
    lookup = spark.createDataFrame([(1, 1000)], "k int, n bigint")
    hot = skew.hot_keys(lookup, ["k"], "n", 100)
    salted, spread = skew.salted_sides(rows, lookup, ["k"], hot, "n", ["id"], 100)
    assert spread.count() == 10
    assert salted.groupBy("_salt").count().agg(F.max("count")).first()[0] < 200


def test_spread_raises_partitions_only(spark):
    assert skew.spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == 4
    assert skew.spread(spark.range(0, 10, 1, 9), "id").rdd.getNumPartitions() == 9


def test_scratch_folder_is_the_configured_one(spark):
    assert skew.scratch_folder(spark)
