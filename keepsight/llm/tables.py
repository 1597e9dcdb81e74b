"""Tables written to the folder that driver and executors share.

Lineage is cut by writing Parquet below spark.checkpoint.dir; a lost executor
then costs a re-read, never a recomputation of what was random, sampled or
numbered by partition. Where the setting is absent, a temporary folder of this
machine serves a local master (tests), whose executors are the driver itself;
on a cluster that is an error. The folder goes when the application ends, and
the tables of a scope when the scope does.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_ends: set[str] = set()
_scopes: list[list[Table]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, which goes with the application: below spark.checkpoint.dir, else one of our own for a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        where = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="keepsight-"))
    folder = f"{where.rstrip('/')}/keepsight-{app}"
    if folder not in _ends:
        _ends.add(folder)
        path, fs = hadoop_path(spark, folder)
        fs.deleteOnExit(path)
    return folder


def hadoop_path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, where: str) -> None:
    path, fs = hadoop_path(spark, where)
    fs.delete(path, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables made inside are deleted at its end; what is needed after it must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for t in _scopes.pop():
            t.drop()


def keep(t: Table) -> None:
    """t outlives the scope it was made in."""
    if _scopes and t in _scopes[-1]:
        _scopes[-1].remove(t)


class Table:
    """A written table: read() gives it as a DataFrame, drop() deletes its files."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        if _scopes:
            _scopes[-1].append(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back."""
    return Table(df, name).read()


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; for when no result that reads them is needed any more."""
    delete(spark, shared_dir(spark))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of plans that nothing refers to any more.

    The first round drops what Python held, the second what only the JVM did;
    the cleaner works beside the driver and gets a moment for it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def answer_groups(leaders: DataFrame, answers: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(pid, lid, values): the answer for the key of each task's local group.

    leaders holds one row for each distinct key of a task, so a key shared by a
    third of all rows meets its answer in at most one row for each task. Keys
    join null-safely. answers must be a written table: both sides are then plain
    exchanges, which adaptive execution can split.
    """
    on = [leaders[k].eqNullSafe(answers[k]) for k in key]
    return leaders.join(answers, on).select(leaders["pid"], leaders["lid"], *[answers[v] for v in values])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. One of fewer partitions than there are cores is dealt out to them; larger ones stay as they lie."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def own_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so extra columns of the input can clash with nothing."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def text_key(text: str | None) -> int:
    """What xxhash64(coalesce(text, '')) gives in Spark."""
    import xxhash

    x = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, for caches that later tasks use again."""
    import sys
    import types

    return sys.modules.setdefault("keepsight_worker_state", types.ModuleType("keepsight_worker_state")).__dict__
