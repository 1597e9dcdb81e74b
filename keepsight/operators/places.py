"""Places: smoothed frame labels, visits, and which objects are where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsight.operators.ranges import Ranges
from keepsight.operators.windows import counted_until, first_appearance, label_islands, last_numbers, majority_filter, picked, top_k


def visits(frames: DataFrame, keys: list[str], time: str, label: str, half: int = 1, ranges: Ranges | None = None) -> DataFrame:
    """Visits (label, t0, t1, n_frames, place_id) of frames in time order, after smoothing; ranges of time cut a recording that is too long for one task."""
    smooth = label_islands(majority_filter(frames, keys, [time], label, half, ranges), keys, [time], label, "visit", ranges)
    v = smooth.groupBy(*keys, "visit", label).agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n_frames"))
    return first_appearance(v, keys, label, "t0", "place_id")


def places(v: DataFrame, keys: list[str], label: str) -> DataFrame:
    return v.groupBy(*keys, "place_id", label).agg(F.count("*").alias("n_visits"), F.sum("n_frames").alias("n_frames"), F.min("t0").alias("first_s"), F.max("t1").alias("last_s"))


def object_places(obs: DataFrame, keys: list[str], object_id: str, place: str, time: str) -> DataFrame:
    """Observations of each object at each place."""
    return obs.groupBy(*keys, object_id, place).agg(F.count("*").alias("n_obs"), F.min(time).alias("first_s"), F.max(time).alias("last_s"))


def kinds_here(objects: DataFrame, keys: list[str], name: str, n_obs: str, object_id: str, kinds: int = 12) -> DataFrame:
    """Most frequent kinds of a place with their multiplicity; ties in order of (n_obs, id as text), largest first. more: kinds left out."""
    order = Window.partitionBy(*keys).orderBy(F.desc(n_obs), F.col(object_id).cast("string").desc())
    counts = objects.withColumn("_o", F.row_number().over(order)).groupBy(*keys, name).agg(F.count("*").alias("n"), F.min("_o").alias("_first"))
    total = counts.withColumn("more", F.greatest(F.lit(0), F.count("*").over(Window.partitionBy(*keys)) - kinds))
    return top_k(total, keys, [F.desc("n"), "_first"], kinds).drop("_first")


def current_visit(v: DataFrame, questions: DataFrame, keys: list[str], until: str, last: int = 12) -> DataFrame:
    """The last visits begun by a question's time, the end of each clipped to it, newest first."""
    counted, numbered = counted_until(questions, v, keys, F.col(until), ["t0"])
    seen = picked(counted, numbered, keys, last_numbers(F.col("n_before"), last)).withColumn("t1", F.least("t1", F.col(until)))
    return seen.withColumn("back", (F.col("n_before") - F.col("i") + 1).cast("int")).drop("n_before", "i")
