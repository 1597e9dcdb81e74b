"""Exact percentiles by narrowing equal Spark's own, whatever is held at once; sketches stay within their error."""

import random

import pytest
from pyspark.sql import functions as F

from keepsight.operators import quantiles


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(6)
    draw = {"ties": lambda: float(rng.randint(0, 2)), "tails": lambda: rng.choice((-1, 1)) * 10.0 ** rng.uniform(-200, 200), "one": lambda: 7.5, "odd": lambda: rng.choice((float("nan"), float("inf"), float("-inf"), None, rng.random())), None: rng.random}
    rows = [(k, f(), rng.gauss(0, 1) if rng.random() < 0.9 else None) for k, f in draw.items() for _ in range(1500)]
    rows += [("edge", 0.0, float(i)) for i in range(800)] + [("edge", 1.0 + i, None) for i in range(800)]  # the two middle ranks differ, one of them tied
    rows += [("two", 1.0, None), ("two", 4.0, None), ("none", None, None)]
    return spark.createDataFrame(rows, "k string, a double, b double").repartition(3)


@pytest.mark.parametrize(("q", "most"), ((0.5, 100_000), (0.5, 40), (0.5, 2), (0.25, 30), (0.0, 25), (1.0, 25)))
def test_equal_to_the_built_in(values, q, most):
    got = {r["k"]: (r["a"], r["b"]) for r in quantiles.exact_percentiles(values, ["k"], ["a", "b"], q, most).collect()}
    want = {r["k"]: (r["a"], r["b"]) for r in values.groupBy("k").agg(F.percentile("a", q).alias("a"), F.percentile("b", q).alias("b")).collect()}
    assert want.pop("none") == (None, None) and got.keys() == want.keys()
    same = lambda x, y: x == y or x is not None and y is not None and (x != x and y != y or abs(x - y) <= 1e-12 * abs(y))
    assert all(same(x, y) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_no_task_holds_more_than_it_may(values, monkeypatch):
    held = []
    was = quantiles.written
    monkeypatch.setattr(quantiles, "written", lambda df, name: (held.append(df.groupBy("k", "_c", "_of").count().agg(F.max("count")).first()[0]) if name == "between" else None) or was(df, name))
    quantiles.exact_percentiles(values, ["k"], ["a", "b"], most=20).count()
    assert held[0] < 60 and (held[-1] or 0) <= 20  # of 1,500 values a group, a few hundredths go on


def test_whole_table_and_empty(values):
    got = quantiles.exact_percentiles(values.filter("k is null"), [], ["a"], most=10).collect()
    assert got == values.filter("k is null").agg(F.percentile("a", 0.5).alias("a")).collect()
    assert quantiles.exact_percentiles(values.limit(0), ["k"], ["a"]).collect() == []


def test_sketches_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).alias("day"), F.sqrt(F.col("id").cast("double")).alias("v"))
    merged = quantiles.merged_sketches(quantiles.sketches(df, ["k", "day"], "v"), ["k"])
    for r in merged.select("k", quantiles.sketched_percentile(F.col("sketch")).alias("m"), F.length("sketch").alias("size")).collect():
        below = df.filter((F.col("k") == r["k"]) & (F.col("v") <= r["m"])).count()
        assert abs(below / 25_000 - 0.5) < 0.03 and r["size"] < 10_000
