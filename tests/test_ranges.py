"""Operators that cut a key into ranges equal one window over the key, whatever the ranges; a hot key is many tasks."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from keepsight.operators import joins, ranges, windows


def track(n=400, seed=3):
    """One key with nearly all rows, short ones and a null one; times with ties, gaps and nulls."""
    rng = random.Random(seed)
    rows = [(rng.choice((1, 1, 1, 1, 1, 2, 3, None)), rng.choice((float(rng.randint(-40, 160)), rng.random() * 900, None)), i, rng.choice("AABC")) for i in range(n)]
    return rows + [(7, 5.0, n, "A")]


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(track(), "k int, t double, pos int, label string").repartition(4)


def cuts(obs):
    return [ranges.every(7.0), ranges.every(1e6), ranges.balanced(obs, "t", 9), lambda t: t]


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_numbers_and_islands_equal_one_window(obs):
    order = ["t", "pos"]
    for cut in cuts(obs):
        assert same(ranges.ranked(obs, ["k"], order, cut), ranges.ranked(obs, ["k"], order))
        for f in (lambda **o: windows.gap_islands(obs, ["k"], order, "t", 4.0, **o), lambda **o: windows.label_islands(obs, ["k"], order, "label", **o)):
            assert same(f(ranges=cut), f())


def test_smoothing_equals_one_window(obs):
    for half in (1, 2, 5):
        want = windows.majority_filter(obs, ["k"], ["t", "pos"], "label", half)
        for cut, block in ((ranges.every(7.0), 1), (ranges.balanced(obs, "t", 5), 8)):
            assert same(windows.majority_filter(obs, ["k"], ["t", "pos"], "label", half, cut, block), want)


def listed(rows, k, t, forward, first):
    """The row the reference's scan takes: of the latest (or earliest) time the first or last listed."""
    seen = [r for r in rows if r[0] == k and r[1] is not None and t is not None and (r[1] >= t if forward else r[1] <= t)]
    if not seen:
        return None
    at = (min if forward else max)(r[1] for r in seen)
    return (min if first else max)(r[2] for r in seen if r[1] == at)


@pytest.mark.parametrize("forward", (False, True))
@pytest.mark.parametrize("first", (False, True))
def test_asof_takes_the_listed_row_of_equal_times(spark, obs, forward, first):
    asked = [(k, t, i) for i, (k, t) in enumerate([(k, t) for k in (1, 2, 3, None, 9) for t in (-99.0, -1.0, 0.0, 3.5, 77.0, 150.0, 5000.0, None)])]
    left = spark.createDataFrame(asked, "k int, q double, ask int")
    want = [(i, listed(track(), k, t, forward, first)) for k, t, i in asked]
    for cut in (None, *cuts(obs)):
        got = joins.asof_join(left, obs.withColumn("found", F.col("pos")), ["k"], "q", "t", ["found"], forward=forward, tie="pos", first=first, ranges=cut)
        assert sorted((r["ask"], r["found"]) for r in got.collect()) == want


def test_asof_expires_across_ranges(spark):
    left = spark.createDataFrame([(1, 100.0), (1, 20.0)], "k int, q double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 15.0, "b")], "k int, t double, v string")
    got = joins.asof_join(left, right, ["k"], "q", "t", ["v"], max_age=10.0, ranges=ranges.every(2.0))
    assert sorted((r["q"], r["v"]) for r in got.collect()) == [(20.0, "b"), (100.0, None)]


def test_bracket_takes_the_last_before_and_the_first_after(spark):
    seen = spark.createDataFrame([(1, 0.0, 1.0, 0), (1, 0.0, 2.0, 1), (1, 10.0, 3.0, 2), (1, 10.0, 4.0, 3)], "k int, t double, x double, pos int")
    ask = spark.createDataFrame([(1, 5.0), (1, 0.0), (1, 11.0), (1, -1.0)], "k int, t double")
    for cut in (None, ranges.every(1.0)):
        b = joins.interpolated(joins.bracket_join(ask, seen, ["k"], "t", ["x"], "pos", cut), "t", "x")
        got = {r["t"]: (r["x"], r["source"]) for r in b.withColumn("source", joins.provenance()).collect()}
        assert got == {5.0: (2.5, "between the views at 0.0 s and 10.0 s"), 0.0: (2.0, "seen at 0.0 s"), 11.0: (4.0, "last seen at 10.0 s, not seen since"), -1.0: (1.0, "first seen at 0.0 s, after the question")}


def test_balanced_ranges_follow_skew(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, F.col("id") / 1e6).otherwise(F.col("id") * 1.0).alias("t"))
    number = ranges.balanced(df, "t", 16)
    sizes = [r["count"] for r in df.groupBy(number(F.col("t")).alias("r")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    edges = sorted(set(df.approxQuantile("t", [i / 16 for i in range(1, 16)], 1e-3)))
    for row in df.sample(0.01, 1).select("t", number(F.col("t")).alias("r")).collect():
        assert row["r"] == bisect_right(edges, row["t"]) >= bisect_left(edges, row["t"])


def test_a_hot_key_is_many_tasks(spark):
    """All rows have one key; without ranges one task has them all, with ranges none has more than a fraction."""
    one = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") * 1.0).alias("t"), F.col("id").alias("pos"), (F.col("id") % 3).cast("string").alias("label"))
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        largest = lambda df: max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.xxhash64(*df.columns))).collect())
        cut = ranges.balanced(one, "t", 64)
        asked = one.select("k", (F.col("t") + 0.5).alias("q"))
        for f in (
            lambda r: joins.asof_join(asked, one, ["k"], "q", "t", ["pos"], tie="pos", ranges=r), lambda r: windows.label_islands(one, ["k"], ["t"], "label", ranges=r),
            lambda r: windows.gap_islands(one, ["k"], ["t"], "t", 0.5, ranges=r), lambda r: windows.majority_filter(one, ["k"], ["t"], "label", 1, r),
        ):
            assert largest(f(None)) == 40_000 and largest(f(cut)) < 16_000
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
