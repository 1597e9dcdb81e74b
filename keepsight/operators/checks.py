"""Filters of detections and tracks, and checks of whole recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.functions.geometry import project, to_camera


def usable_detections(dets: DataFrame, area: str, frame_area: str, min_score: float = 0.5, max_fraction: float = 0.6) -> DataFrame:
    return dets.filter((F.col("score") >= min_score) & (F.col(area) > 0) & (F.col(area) <= max_fraction * F.col(frame_area)))


def without_scene_spanning(tracks: DataFrame, keys: list[str], area: str, frame_area: str, max_fraction: float = 0.6) -> DataFrame:
    """Tracks whose median coverage, over the frames they are in, isn't above max_fraction."""
    large = tracks.groupBy(*keys).agg(F.median(F.col(area) / F.col(frame_area)).alias("_m")).filter(F.col("_m") > max_fraction)
    return tracks.join(large, keys, "left_anti")


def track_scores(tracks: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Best score and last tag of each track, and the share of its frames with any pixel."""
    return tracks.groupBy(*keys).agg(F.max("score").alias("best_score"), F.max_by("tag", pos).alias("last_tag"), F.avg((F.col("area") > 0).cast("double")).alias("coverage"))


def mean_intrinsics(k: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise median over frames of fx, fy, cx, cy."""
    return k.groupBy(*keys).agg(*[F.median(c).alias(c) for c in ("fx", "fy", "cx", "cy")])


def is_circular_fisheye(width, height, corners, centre):
    """Square frames with four dark corners (medians) and a bright centre (mean)."""
    return (width == height) & F.forall(corners, lambda c: c < 16) & (centre > 20)


def coherence(obs: DataFrame, keys: list[str]) -> DataFrame:
    """How well object centres project into their own boxes: share inside, and median pixels off.

    Points inside count 0 pixels; points behind the camera are misses without
    pixels. obs: world, r, t, fx, fy, cx, cy, box.
    """
    cam = to_camera(F.col("r"), F.col("t"), F.col("world"))
    uv = project(cam, *map(F.col, ("fx", "fy", "cx", "cy")))
    p = obs.withColumn("_uv", uv)
    u, v, b = F.col("_uv.u"), F.col("_uv.v"), F.col("box")
    inside = F.coalesce(u.between(b["x1"], b["x2"]) & v.between(b["y1"], b["y2"]), F.lit(False))
    centre = F.hypot(u - (b["x1"] + b["x2"]) / 2, v - (b["y1"] + b["y2"]) / 2)
    return p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("inside"), F.median(F.when(inside, 0.0).otherwise(centre)).alias("median_px"))


def frame_drift(errors: DataFrame, keys: list[str], limit: float = 3.0) -> DataFrame:
    """Median absolute difference of probed frames, and whether the index holds."""
    return errors.groupBy(*keys).agg(F.median("mae").alias("median_mae")).withColumn("ok", F.col("median_mae") < limit)


def seams(chunks: DataFrame, keys: list[str], rmse: str = "rmse") -> DataFrame:
    """Median and largest residual of joining each chunk to the one before; null ones don't count."""
    return chunks.groupBy(*keys).agg(F.median(rmse).alias("seam_median"), F.max(rmse).alias("seam_max"))
