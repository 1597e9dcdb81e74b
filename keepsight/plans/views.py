"""The memory for SQL users: temporary views of its tables, and table functions for what SQL has no short form of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keepsight.functions.sequences import persistent_labels
from keepsight.plans.bindings import observations, points

PREFIX = "memory_"


@F.arrow_udtf(returnType="key long, t0 double, t1 double, n long")
class RunsOf:
    """runs_of(TABLE(key, time_s, gap) PARTITION BY key ORDER BY time_s): runs whose neighbours are at most gap apart."""

    def __init__(self):
        self.key = self.first = self.last = None
        self.n, self.done = 0, []

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        t, gap = table.column("time_s").to_numpy(), table.column("gap")[0].as_py()
        self.key = table.column("key")[0].as_py()
        for start, part in enumerate(np.split(t, np.flatnonzero(np.diff(t) > gap) + 1)):
            if self.n and (start or part[0] - self.last > gap):
                self.done.append((self.key, self.first, self.last, self.n))
                self.n = 0
            if not self.n:
                self.first = float(part[0])
            self.last, self.n = float(part[-1]), self.n + len(part)
        yield self.rows()

    def terminate(self) -> Iterator[pa.Table]:
        if self.n:
            self.done.append((self.key, self.first, self.last, self.n))
        yield self.rows()

    def rows(self) -> pa.Table:
        done, self.done = self.done, []
        return pa.table({"key": pa.array([d[0] for d in done], pa.int64()), "t0": pa.array([d[1] for d in done], pa.float64()), "t1": pa.array([d[2] for d in done], pa.float64()), "n": pa.array([d[3] for d in done], pa.int64())})


@F.arrow_udtf(returnType="key long, pos long, segment int")
class SegmentsOf:
    """segments_of(TABLE(key, pos, x, y, z, radius, k) PARTITION BY key ORDER BY time): persistent segments of a track; -1 belongs to none."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        self.parts.append(table)
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        t = pa.Table.from_batches(self.parts)
        xyz = np.column_stack([pc.cast(t.column(a), pa.float64()).to_numpy() for a in "xyz"])
        labels = persistent_labels(xyz, t.column("radius")[0].as_py(), t.column("k")[0].as_py())
        yield pa.table({"key": t.column("key"), "pos": t.column("pos"), "segment": pa.array(labels, pa.int32())})


def register(spark: SparkSession, sf_dir: str) -> None:
    """Registers memory_observations and memory_points, and the table functions runs_of and segments_of."""
    observations(spark, sf_dir).createOrReplaceTempView(f"{PREFIX}observations")
    points(spark, sf_dir).createOrReplaceTempView(f"{PREFIX}points")
    spark.udtf.register("runs_of", RunsOf)
    spark.udtf.register("segments_of", SegmentsOf)
