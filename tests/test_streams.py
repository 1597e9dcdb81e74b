"""Stateful streams: what comes in any order over micro-batches gives what the batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from keepsight.operators import resolve
from keepsight.streaming.streams import associate_stream, latest_view

SCHEMA = "clip string, tag string, frame long, pos long, score double, x double, y double, z double, x1 double, y1 double, x2 double, y2 double, ts timestamp"


def scene(spark, seed=4, frames=24):
    """Two tags of two clips; some rows without a position, some boxes on top of each other; a row far ahead ends each key's last frame."""
    rng, out = random.Random(seed), []
    for f in range(frames):
        for clip, tag in (("a", "mug"), ("a", "pen"), ("b", "mug")):
            for _ in range(rng.randint(0, 5)):
                x = rng.choice((0.0, rng.uniform(0, 4)))
                p = rng.choice(((x, rng.uniform(0, 1), 0.0), (x, 0.5, 0.0), (None, None, None)))
                out.append((clip, tag, f, len(out), round(rng.random(), 1), *p, 10 * x, 0.0, 10 * x + rng.choice((8.0, 10.0)), 10.0, 1000 + 4 * f))
    df = spark.createDataFrame(out, SCHEMA.replace("ts timestamp", "s long"))
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def streamed(spark, df, tmp_path, make, parts, name, mode="append"):
    """df in files of a random split, one a micro-batch, then a row far ahead in time so that the watermark passes all before."""
    last = df.limit(1).withColumns({"ts": F.lit("2000-01-01").cast("timestamp"), **({"frame": F.lit(10**6).cast("long")} if "frame" in df.columns else {})})
    for i, part in enumerate([*parts, last, last]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def links(df):
    return sorted((r["clip"], r["tag"], r["frame"], r["pos"], r["cluster"]) for r in df.filter("frame < 1000000").collect())


@pytest.mark.parametrize("limit", (None, 0.7))
def test_shuffled_rows_link_as_in_the_batch(spark, tmp_path, limit):
    df = scene(spark).cache()
    boxed = df.withColumn("box", F.struct("x1", "y1", "x2", "y2"))
    kept = boxed if limit is None else resolve.suppress(boxed.select("clip", "tag", "frame", "score", "pos", "box", "x", "y", "z"), ["clip", "tag", "frame"], limit)
    want = links(resolve.associate(kept.select("clip", "tag", "frame", "pos", "score", "x", "y", "z"), ["clip", "tag"]))
    parts = df.randomSplit([1.0] * 4, 3)
    assert all(p.agg(F.max("frame") - F.min("frame")).first()[0] > 15 for p in parts)  # each file has rows of nearly all frames
    got = streamed(spark, df, tmp_path, lambda s: associate_stream(s, "ts", limit=limit, watermark="10 minutes"), parts, f"links_{limit is None}")
    assert links(got) == want and len(want) > 80


def test_clusters_go_on_from_a_batch_and_expire(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    row = lambda frame, pos, x, s: spark.createDataFrame([("a", "mug", frame, pos, 0.9, x, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], SCHEMA.rpartition(",")[0]).withColumn("ts", at(s))
    first = spark.createDataFrame([("a", "mug", 4, 0.0, 0.0, 0.0, 0), ("a", "mug", 7, 5.0, 0.0, 0.0, 95_000)], "clip string, tag string, cluster int, x double, y double, z double, at_ms long")
    df = row(25, 1, 5.1, 100).union(row(26, 2, 0.1, 104)).union(row(60, 3, 5.2, 240))
    got = streamed(spark, df, tmp_path, lambda s: associate_stream(s, "ts", ttl_ms=60_000, initial=first), [df], "expiring")
    assert links(got) == [("a", "mug", 25, 1, 7), ("a", "mug", 26, 2, 8), ("a", "mug", 60, 3, 9)]


def test_latest_view_keeps_the_latest_and_forgets(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randint(1000, 1300), rng.choice((1.0, 2.0, None)), rng.choice(("x", "y"))) for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, s long, v double, w string").withColumn("ts", F.timestamp_seconds("s")).drop("s").cache()
    want = {r["k"]: (r["ts"], r["v"], r["w"]) for r in latest_view(df, "ts", ["k"], ["v", "w"]).collect()}
    got = streamed(spark, df, tmp_path, lambda s: latest_view(s, "ts", ["k"], ["v", "w"], "20 minutes", 1000), df.randomSplit([1.0] * 3, 2), "latest", "update")
    told = {}
    for r in got.filter("ts < '1999-01-01'").collect():
        told.setdefault(r["k"], []).append((r["ts"], r["v"] is not None, r["v"] or 0.0, r["w"]))
    assert {k: max(v) for k, v in told.items()} == {k: (t, v is not None, v or 0.0, w) for k, (t, v, w) in want.items()}
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "last").load()
    assert state.select("key.k").distinct().count() == 1  # only the key of the last row; the others' state is gone
