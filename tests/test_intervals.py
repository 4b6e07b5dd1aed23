import random

import pytest
from pyspark.sql import functions as F

from lifeweave.operators.intervals import label_islands, merge_intervals

SCHEMA = "k string, t0 double, t1 double, i int"


def brute(data, max_gap, touching):
    out = []
    for k in {d[0] for d in data if d[0] is not None}:
        periods = []
        for s, e in sorted((d[1], d[2]) for d in data if d[0] == k and d[1] is not None and d[2] is not None and d[2] > d[1]):
            if periods and (s <= periods[-1][1] if touching else s < periods[-1][1]):
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out += [(k, "period", s, e) for s, e in periods]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:]) if b[0] - a[1] <= max_gap]
    return sorted(out)


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force_with_a_hot_key(spark, touching, seed):
    r = random.Random(seed)
    data = []
    for i in range(500):
        k = r.choice("aaaab")
        s = float(r.randint(0, 400 if k == "a" else 2000))
        data.append((k, s, s + r.randint(-1, 5 if seed else 1), i))
    got = sorted(map(tuple, merge_intervals(spark.createDataFrame(data, SCHEMA), "k", "t0", "t1", 3.0, touching).collect()))
    assert got == brute(data, 3.0, touching)


def test_one_island_over_all_partitions(spark):
    data = [("a", 0.0, 1e9, 0)] + [("a", float(i), i + 0.5, i) for i in range(1, 300)] + [("b", 5.0, 6.0, 0)]
    assert sorted(map(tuple, merge_intervals(spark.createDataFrame(data, SCHEMA), "k", "t0", "t1").collect())) == [("a", "period", 0.0, 1e9), ("b", "period", 5.0, 6.0)]


def test_edge_rows(spark):
    data = [(None, 0.0, 1.0, 0), ("a", None, 1.0, 0), ("a", 0.0, None, 0), ("a", float("nan"), 1.0, 0), ("a", 2.0, 2.0, 0), ("a", 3.0, 2.0, 0), ("a", 5.0, 6.0, 0), ("a", 5.0, 6.0, 1), ("a", 6.0, 7.0, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert list(map(tuple, merge_intervals(df, "k", "t0", "t1").collect())) == [("a", "period", 5.0, 7.0)]
    clash = df.withColumn("kind", F.lit("x")).withColumn("start", F.lit(1)).withColumn("s", F.lit(1))
    assert merge_intervals(clash, "k", "t0", "t1").count() == 1
    assert merge_intervals(df.limit(0), "k", "t0", "t1").collect() == [] and label_islands(df.limit(0), ["k"], "t0", "t1").collect() == []


@pytest.mark.parametrize("touching", [True, False])
def test_labels(spark, touching):
    r = random.Random(5)
    data = [(r.choice("aab"), float(r.randint(0, 300)), None, i) for i in range(400)]
    rows = label_islands(spark.createDataFrame(data, SCHEMA), ["k"], "t0", F.col("t0") + 2, "x", touching).collect()
    assert len(rows) == 400
    for k in "ab":
        now, end = None, float("-inf")
        for t, x in sorted((q["t0"], q["x"]) for q in rows if q["k"] == k):
            if t > end if touching else t >= end:
                now = t
            end = max(end, t + 2)
            assert x == now


def test_copies_of_one_interval_are_spread(spark):
    from lifeweave.operators.intervals import _ordered, _prepare

    df = spark.range(4000).select(F.when(F.col("id") < 3000, "a").otherwise("b").alias("k"), F.lit(5.0).alias("t0"), F.lit(6.0).alias("t1"), F.col("id").cast("int").alias("i"))
    sizes = [r["count"] for r in _ordered(_prepare(df, ["k"], "t0", "t1"), ["k"]).groupBy("__pid").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert {r["x"] for r in label_islands(df, ["k"], "t0", "t1", "x").collect()} == {5.0} and merge_intervals(df, "k", "t0", "t1").count() == 2
