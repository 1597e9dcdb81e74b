"""Intermediate tables in the folder that driver and executors share.

The folder is spark.checkpoint.dir; only a local master without that setting
gets a temporary one. What is written there is read again, never computed again,
so a lost executor costs a re-read. All of it goes when the application ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_passing: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _folders:
        where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not where:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
            where = "file://" + tempfile.mkdtemp(prefix="keepsight-")
        folder = f"{where.rstrip('/')}/keepsight-core-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written inside, unless it is to stay, goes at the end, and so do the shuffle files of finished queries."""
    paths: list[str] = []
    _passing.append(paths)
    try:
        yield
    finally:
        _passing.remove(paths)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        # Spark removes a shuffle once the driver has collected the query that made it.
        gc.collect()
        spark._jvm.System.gc()


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df as a table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _passing and not stays:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table bucketed and sorted by a key, so that joins on it don't shuffle this side."""
    table = f"keepsight_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(df.sparkSession)}/{table}").saveAsTable(table)
    return df.sparkSession.table(table)
