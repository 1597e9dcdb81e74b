"""Committed stages: a reader sees whole versions only, whatever happens to writers."""

import threading

import pytest
from pyspark.sql import functions as F

from keepsight.sources import readers

SCHEMA = "clip_uid string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def read(spark, path, **options):
    return sorted(((r["clip_uid"], r["v"]) for r in readers.read_stage(spark, path, SCHEMA, **options).collect()), key=repr)


def test_versions_replace_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert read(spark, path) == []
    assert readers.commit_stage(frame(spark, [("a", 1), ("a", 2), ("b c/d", 3), (None, 4)]), path) == 1
    assert readers.commit_stage(frame(spark, [("a", 9), ("e", 5)]), path) == 2
    assert read(spark, path) == sorted([("a", 9), ("b c/d", 3), (None, 4), ("e", 5)], key=repr)
    assert read(spark, path, version=1) == sorted([("a", 1), ("a", 2), ("b c/d", 3), (None, 4)], key=repr)


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "stage")
    readers.commit_stage(frame(spark, [("a", 1)]), path)
    with pytest.raises(Exception, match="lost"):  # in the middle of its files
        readers.commit_stage(frame(spark, [("a", i) for i in range(50)]).withColumn("v", F.when(F.col("v") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), path)
    frame(spark, [("a", 7)]).withColumn("_part", F.col("clip_uid")).write.partitionBy("_part").parquet(f"{path}/data-orphan")  # after them, before the manifest
    assert read(spark, path) == [("a", 1)]
    assert readers.commit_stage(frame(spark, [("b", 2)]), path) == 2 and read(spark, path) == [("a", 1), ("b", 2)]


def test_writers_at_the_same_time_both_count(spark, tmp_path):
    path = str(tmp_path / "stage")
    threads = [threading.Thread(target=lambda k=k: readers.commit_stage(frame(spark, [(f"clip{k}", k), ("shared", k)]), path)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = read(spark, path)
    assert readers.committed(spark, path)[0] == 4
    assert [x for x in got if x[0] != "shared"] == [(f"clip{k}", k) for k in range(4)] and sum(x[0] == "shared" for x in got) == 1
