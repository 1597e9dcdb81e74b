"""Camera tracks: chaining chunks, anchoring, and rescaling."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.functions.geometry import robust_similarity, similarity_fit
from keepsight.operators.resolve import in_runs
from keepsight.operators.sets import widened


def chain_chunks(poses: DataFrame, keys: list[str], min_shared: int = 3) -> DataFrame:
    """Brings overlapping chunks of camera centres (chunk, frame, x, y, z) into the frame of the first one.

    A chunk that shares fewer than min_shared frames with what is chained so far
    is dropped; a fit that fails starts a new epoch. Later chunks overwrite
    frames. Gives frame, x, y, z, epoch, seam (rms of the chunk's fit).
    """
    schema = widened(poses.select(*keys, "frame", "x", "y", "z"), epoch="int", seam="double")
    n = len(keys)

    def chain(rows: list[tuple]) -> list[tuple]:
        placed: dict[int, tuple] = {}
        epoch = 0
        for _, g in groupby(rows, key=itemgetter(n)):
            chunk = list(g)
            frames, points, seam = [r[n + 1] for r in chunk], np.array([r[n + 2 :] for r in chunk], float), 0.0
            shared = [k for k, f in enumerate(frames) if f in placed]
            if placed and len(shared) < min_shared:
                continue
            if placed:
                target = np.array([placed[frames[k]][:3] for k in shared])
                try:
                    s, r, t = similarity_fit(points[shared], target)
                    if not np.isfinite(s) or s <= 0:
                        raise np.linalg.LinAlgError
                    points = s * points @ r.T + t
                    seam = float(np.sqrt(((points[shared] - target) ** 2).sum(1).mean()))
                except np.linalg.LinAlgError:
                    epoch += 1
            for f, p in zip(frames, points.tolist()):
                placed[f] = (*p, epoch, seam)
        return [(*rows[0][:n], f, *v) for f, v in sorted(placed.items())]

    # Rows come clip by clip and in order, so a clip costs its fits and no group of its own.
    laid = poses.select(*keys, "chunk", "frame", *[F.col(a).cast("double") for a in "xyz"]).filter("chunk is not null")
    laid = laid.repartition(int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "chunk", "frame")
    return laid.mapInArrow(in_runs(chain, list(range(n)), schema), schema)


def anchor_track(poses: DataFrame, anchors: DataFrame, keys: list[str], min_anchors: int = 8) -> DataFrame:
    """Moves a track to known positions (ax, ay, az) of some of its frames, by a similarity that ignores outliers; tracks with fewer than min_anchors are absent."""
    both = poses.join(anchors, [*keys, "frame"], "left")
    schema = widened(poses.select(*keys, "frame", "x", "y", "z"), scale="double")

    def anchor(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["ax"].notna()
        if known.sum() < min_anchors:
            return pdf.head(0)[[*keys, "frame", "x", "y", "z"]].assign(scale=0.0)
        src, dst = (pdf.loc[known, c].to_numpy(float) for c in (["x", "y", "z"], ["ax", "ay", "az"]))
        s, r, t, _ = robust_similarity(src, dst)
        moved = s * pdf[["x", "y", "z"]].to_numpy(float) @ r.T + t
        return pdf[[*keys, "frame"]].assign(x=moved[:, 0], y=moved[:, 1], z=moved[:, 2], scale=s)

    return both.groupBy(*keys).applyInPandas(anchor, schema)


def rescaled(table: DataFrame, scales: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns times each clip's scale (1 where it has none); base tables stay as they are, so nothing is scaled twice."""
    joined = table.join(scales.select(*keys, F.col("scale").alias("_s")), keys, "left").withColumn("_s", F.coalesce("_s", F.lit(1.0)))
    return joined.withColumns({c: F.col(c) * F.col("_s") for c in columns}).drop("_s")


def with_pose(obs: DataFrame, track: DataFrame, keys: list[str]) -> DataFrame:
    """Observations whose frame has a pose, with it."""
    return obs.join(track, [*keys, "frame"])


def depth_scale(pixels: DataFrame, keys: list[str], least: float = 0.05, min_pixels: int = 500) -> DataFrame:
    """Scale between two depth maps of each clip: the median over frames of the median ratio a / b of a frame's pixels.

    Pixels count where both depths are finite and b is above least, frames where
    more than min_pixels do. Quartiles of the frames' ratios tell how far to trust it.
    """
    ok = pixels.filter(~F.isnan("a") & ~F.isnan("b") & (F.abs("a") < float("inf")) & (F.abs("b") < float("inf")) & (F.col("b") > least))
    frames = ok.groupBy(*keys, "frame").agg(F.median(F.col("a") / F.col("b")).alias("_r"), F.count("*").alias("_n")).filter(F.col("_n") > min_pixels)
    return frames.groupBy(*keys).agg(F.median("_r").alias("scale"), F.percentile("_r", 0.25).alias("q1"), F.percentile("_r", 0.75).alias("q3"), F.count("*").alias("n_frames"))
