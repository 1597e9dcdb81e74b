"""Functions over ordered arrays, and index arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def even_indices(n: Column, m: int) -> Column:
    """Up to m evenly spaced indices of 0..n-1, the ends among them.

    The step is a double, multiplied and truncated; the last index is exact. It is
    over 1 where indices are spaced, so none comes twice.
    """
    step = (n - 1).cast("double") / F.lit(float(max(m - 1, 1)))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.when(i == m - 1, n - 1).otherwise((i * step).cast("int")).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= m, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(spaced)


def frame_video(clip_frame: Column, ratio: Column, offset: Column) -> Column:
    return ratio * clip_frame + offset


def frame_time(clip_frame: Column, ratio: Column, offset: Column, fps: Column) -> Column:
    return frame_video(clip_frame, ratio, offset) / fps


def threshold_segments(points: Column, limit: float) -> Column:
    """Segment number of each point of a time-sorted array of structs x, y, z.

    A new segment starts where a point is farther than limit from the mean of
    the current one.
    """
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0).alias("n"), F.lit(-1).alias("seg"), F.array().cast("array<int>").alias("out"))

    def step(s, p):
        d = F.sqrt(sum((p[k] - s[k] / s["n"]) * (p[k] - s[k] / s["n"]) for k in "xyz"))
        new = (s["n"] == 0) | F.when(s["n"] > 0, d > limit).otherwise(True)
        seg = s["seg"] + new.cast("int")
        return F.struct(*[F.when(new, p[k]).otherwise(s[k] + p[k]).alias(k) for k in "xyz"], F.when(new, 1).otherwise(s["n"] + 1).alias("n"), seg.alias("seg"), F.concat(s["out"], F.array(seg)).alias("out"))

    return F.aggregate(points, start, step, lambda s: s["out"])


def persistent_segments(points: Column, limit: float, k: int) -> Column:
    """Segment number of each point, or -1 for points that belong to none.

    A point beyond limit of the segment's mean is pending. k pending points in
    a row become a new segment; a point within limit forgets them.
    """
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0).alias("n"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), F.lit(0).alias("pn"), F.lit(0).alias("seg"), F.array().cast("array<int>").alias("out"))

    def step(s, p):
        d = F.when(s["n"] > 0, F.sqrt(sum((p[c] - s[c] / F.greatest(s["n"], F.lit(1))) * (p[c] - s[c] / F.greatest(s["n"], F.lit(1))) for c in "xyz")))
        inside = (s["n"] == 0) | F.coalesce(d <= limit, F.lit(True))
        turned = ~inside & (s["pn"] + 1 >= k)
        held = F.slice(s["out"], 1, F.size(s["out"]) - (k - 1)) if k > 1 else s["out"]
        out = F.when(inside, F.concat(s["out"], F.array(s["seg"]))).when(turned, F.concat(held, F.array_repeat(s["seg"] + 1, k))).otherwise(F.concat(s["out"], F.array(F.lit(-1))))
        return F.struct(
            *[F.when(inside, s[c] + p[c]).when(turned, s["p" + c] + p[c]).otherwise(s[c]).alias(c) for c in "xyz"],
            F.when(inside, s["n"] + 1).when(turned, s["pn"] + 1).otherwise(s["n"]).alias("n"),
            *[F.when(inside | turned, 0.0).otherwise(s["p" + c] + p[c]).alias("p" + c) for c in "xyz"],
            F.when(inside | turned, 0).otherwise(s["pn"] + 1).alias("pn"),
            (s["seg"] + turned.cast("int")).alias("seg"),
            out.alias("out"),
        )

    return F.aggregate(points, start, step, lambda s: s["out"])


def suppressed(detections: Column, overlap, limit: float) -> Column:
    """Greedy non-maximum suppression of a score-sorted array: keeps what overlaps no kept one by limit or more."""
    return F.aggregate(F.slice(detections, 2, F.size(detections)), F.slice(detections, 1, 1), lambda kept, d: F.when(F.exists(kept, lambda x: overlap(x, d) >= limit), kept).otherwise(F.concat(kept, F.array(d))))


def persistent_labels(points: np.ndarray, limit: float, k: int) -> np.ndarray:
    """persistent_segments of an array of points, in one pass, for tracks of any length."""
    out, total, n, segment = np.full(len(points), -1, np.int32), np.zeros(3), 0, 0
    pending: list[int] = []
    for i, p in enumerate(points):
        gap = p - total / n if n else np.zeros(3)
        if not n or np.sqrt((gap * gap).sum()) <= limit:
            out[i], total, n, pending = segment, total + p, n + 1, []
            continue
        pending.append(i)
        if len(pending) == k:
            segment += 1
            out[pending], total, n = segment, points[pending].sum(0), k
            pending = []
    return out


def threshold_labels(points: np.ndarray, limit: float) -> np.ndarray:
    """threshold_segments of an array of points, in one pass."""
    out, total, n, segment = np.empty(len(points), np.int32), np.zeros(3), 0, -1
    for i, p in enumerate(points):
        gap = p - total / n if n else np.zeros(3)
        if not n or np.sqrt((gap * gap).sum()) > limit:
            total, n, segment = np.zeros(3), 0, segment + 1
        out[i], total, n = segment, total + p, n + 1
    return out


def labelled_tracks(points, keys: list[str], order: str, labels, *options):
    """Rows of points (with x, y, z) and their segment by labels(points, *options), a track at a time as a grouped Arrow map."""
    import pyarrow as pa

    schema = points.select(*keys, order, F.lit(0).cast("int").alias("segment")).schema

    def run(track: pa.Table) -> pa.Table:
        track = track.sort_by(order)
        xyz = np.column_stack([track.column(a).to_numpy() for a in "xyz"]) if track.num_rows else np.empty((0, 3))
        return track.select([*keys, order]).append_column("segment", pa.array(labels(xyz, *options), pa.int32()))

    return points.select(*keys, order, "x", "y", "z").groupBy(*keys).applyInArrow(run, schema)
