"""What was known at a time: causal snapshots and scene filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.operators.aggregates import quantised
from keepsight.operators.joins import asof_join


def snapshot_objects(obs: DataFrame, keys: list[str], until: str, time: str = "time_s") -> DataFrame:
    """Objects as known at `until` (a column; null takes all): counts, range and medians of the rows up to it."""
    seen = obs.filter(F.col(time).isNotNull() & (F.col(until).isNull() | (F.col(time) <= F.col(until))))
    return seen.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.min(time).alias("first_s"), F.max(time).alias("last_s"), *[quantised(F.median(a), 3).alias(a) for a in "xyz"])


def without_summaries(objects: DataFrame, until: str) -> DataFrame:
    """Objects without summaries, which are written from all segments; a null `until` keeps them."""
    return objects.withColumn("summary", F.when(F.col(until).isNull(), F.col("summary")))


def snapshot_segments(segments: DataFrame, until: str, points: DataFrame | None = None, keys: list[str] | None = None, time: str = "time_s", tie: str | None = None) -> DataFrame:
    """Segments begun by `until`, their ends clipped; a description from a later frame is withheld.

    Such a segment's `world`, if segments have one, becomes that of the last
    positioned row of points (keys, time, world) from its start to `until`; without
    such a row it stays; of rows of one time the last by tie counts. A `summary` of the segment's object is withheld.
    """
    t = F.col(until)
    kept = segments.filter(F.col("t0").isNotNull() & (t.isNull() | (F.col("t0") <= t)))
    if "world" in segments.columns:
        if points is None or not keys:
            raise ValueError("segments with a world position need points and keys")
        seen = points.filter(F.col(time).isNotNull() & F.col("world").isNotNull()).select(*keys, F.col(time).alias("_seen_s"), F.col("world").alias("_seen"), *([F.col(tie).alias("_listed")] if tie else []))
        # The last row by `until` is in the segment if any is.
        last = asof_join(kept.withColumn("_until", t), seen.withColumn("_s", F.col("_seen_s")), keys, "_until", "_s", ["_seen_s", "_seen"], tie="_listed" if tie else None, first=False)
        kept = last.withColumn("world", F.when((F.col("rep_s") > t) & (F.col("_seen_s") >= F.col("t0")), F.col("_seen")).otherwise(F.col("world"))).select(*segments.columns)
    if "summary" in segments.columns:
        kept = without_summaries(kept, until)
    end = F.when(t.isNull(), F.col("t1")).otherwise(F.least(F.coalesce("t1", t), t))
    return kept.withColumn("t1", end).withColumn("description", F.when(t.isNull() | (F.col("rep_s") <= t), F.col("description")))


def scene_segments(segments: DataFrame, since: str) -> DataFrame:
    """Segments that end since the scene began, or have no end (0 and null take all); nothing is clipped."""
    return segments.filter(F.coalesce(F.col(since), F.lit(0.0)).isin(0.0) | F.col("t1").isNull() | (F.col("t1") >= F.col(since)))


def scene_objects(obs: DataFrame, keys: list[str], since: str, time: str = "time_s") -> DataFrame:
    """Objects with rows since the scene began (0 and null take all); counts and range only."""
    kept = obs.filter(F.coalesce(F.col(since), F.lit(0.0)).isin(0.0) | (F.col(time) >= F.col(since)))
    return kept.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.min(time).alias("first_s"), F.max(time).alias("last_s"))
