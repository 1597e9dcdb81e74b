"""Geometry as Column arithmetic, and the few fits that need linear algebra.

Boxes are structs x1, y1, x2, y2; points are structs x, y, z. Camera axes are
x right, y down, z forward; a pose maps world to camera.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sectors around the camera, clockwise from the front; relations and their inverses.
SECTORS = ["front", "front-right", "right", "back-right", "back", "back-left", "left", "front-left"]
INVERSE = {"left of": "right of", "right of": "left of", "in front of": "behind", "behind": "in front of", "on": "under", "under": "on", "above": "below", "below": "above", "near": "near"}
# Default thresholds of relations.
RELATION_LIMITS = {"lateral": 0.15, "depth": 0.25, "vertical": 0.15, "axis_margin": 1.5, "near": 1.0, "on_overlap": 0.5, "on_xy": 0.6}


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def side_px(b: Column) -> Column:
    """Side of the square of a box's area, truncated."""
    return F.sqrt(area(b)).cast("int")


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where nothing overlaps or the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller box; 0 if one is empty."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def horizontal_overlap(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    return F.greatest(F.lit(0.0), wide) / F.greatest(F.lit(1e-6), F.least(a["x2"] - a["x1"], b["x2"] - b["x1"]))


def distance(a: Column, b: Column) -> Column:
    d = [a[k] - b[k] for k in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def to_world(r: Column, t: Column, cam: Column) -> Column:
    """Camera point to world: the transpose of r times (cam - t); r is an array of three rows."""
    d = [cam[k] - t[k] for k in "xyz"]
    return point(*[r[0][c] * d[0] + r[1][c] * d[1] + r[2][c] * d[2] for c in range(3)])


def to_camera(r: Column, t: Column, w: Column) -> Column:
    return point(*[r[i][0] * w["x"] + r[i][1] * w["y"] + r[i][2] * w["z"] + t[k] for i, k in enumerate("xyz")])


def camera_centre(r: Column, t: Column) -> Column:
    return to_world(r, t, point(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def compose(r1: Column, t1: Column, r2: Column, t2: Column) -> tuple[Column, Column]:
    """The pose that does (r1, t1) first and (r2, t2) then."""
    r = F.array(*[F.array(*[r2[i][0] * r1[0][c] + r2[i][1] * r1[1][c] + r2[i][2] * r1[2][c] for c in range(3)]) for i in range(3)])
    return r, to_camera(r2, t2, t1)


def project(cam: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel of a camera point; null behind the camera."""
    ahead = cam["z"] > 0
    return F.struct(F.when(ahead, fx * cam["x"] / cam["z"] + cx).alias("u"), F.when(ahead, fy * cam["y"] / cam["z"] + cy).alias("v"))


def default_intrinsics(height: Column, width: Column) -> Column:
    f = F.greatest(height, width).cast("double")
    return F.struct(f.alias("fx"), f.alias("fy"), (width / 2.0).alias("cx"), (height / 2.0).alias("cy"))


def unpadded_intrinsics(k: Column, padded: Column, width: Column, height: Column) -> Column:
    """Intrinsics of a frame that was centred on a square and resized to `padded` pixels, in the frame's own pixels."""
    scale = F.greatest(width, height) / padded
    return F.struct((k["fx"] * scale).alias("fx"), (k["fy"] * scale).alias("fy"), (k["cx"] * scale - (F.greatest(width, height) - width) / 2.0).alias("cx"), (k["cy"] * scale - (F.greatest(width, height) - height) / 2.0).alias("cy"))


def azimuth(right: Column, ahead: Column) -> Column:
    return F.degrees(F.atan2(right, ahead))


def elevation(right: Column, down: Column, ahead: Column) -> Column:
    return F.degrees(F.atan2(-down, F.hypot(right, ahead)))


def sector(right: Column, ahead: Column) -> Column:
    """One of eight directions; a bin starts at its lower edge."""
    return F.element_at(F.array(*map(F.lit, SECTORS)), (F.floor(F.pmod(azimuth(right, ahead) + 22.5, F.lit(360.0)) / 45) + 1).cast("int"))


def sector_label(right: Column, down: Column, ahead: Column, band: float = 15.0) -> Column:
    e = elevation(right, down, ahead)
    return F.concat(sector(right, ahead), F.when(e > band, ", above eye level").when(e < -band, ", below eye level").otherwise(", about eye level"))


def pair_labels(ca: Column, cb: Column, ba: Column, bb: Column, p: dict[str, float] = RELATION_LIMITS) -> Column:
    """What a is to b, as an array of labels."""
    dx, dy, dz = (ca[k] - cb[k] for k in "xyz")
    beside = (F.abs(dx) >= p["lateral"]) & (F.abs(dx) >= p["axis_margin"] * F.abs(dz))
    along = (F.abs(dz) >= p["depth"]) & (F.abs(dz) >= p["axis_margin"] * F.abs(dx))
    tall = bb["y2"] - bb["y1"]
    on = (dy <= -p["vertical"]) & (F.hypot(dx, dz) <= p["on_xy"]) & (horizontal_overlap(ba, bb) >= p["on_overlap"]) & (ba["y2"] >= bb["y1"] - 0.15 * tall) & (ba["y2"] <= bb["y1"] + 0.5 * tall)
    near = F.sqrt(dx * dx + dy * dy + dz * dz) <= p["near"]
    return F.array_compact(
        F.array(
            F.when(beside, F.when(dx < 0, "left of").otherwise("right of")),
            F.when(along, F.when(dz < 0, "in front of").otherwise("behind")),
            F.when(on, "on").when(dy <= -p["vertical"], "above").when(dy >= p["vertical"], "below"),
            F.when(near, "near"),
        )
    )


def inverse_relation(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv]), label)


def interpolate(t: Column, t0: Column, t1: Column, a: Column, b: Column) -> Column:
    f = (t - t0) / (t1 - t0)
    return point(*[a[k] + (b[k] - a[k]) * f for k in "xyz"])


def point_score(pred: Column, g1: Column, g2: Column) -> Column:
    """l2 (to the first annotation) and success of a predicted point; annotations turn (x, y, z) to (y, -x, z)."""
    turn = lambda g: point(g["y"], -g["x"], g["z"])
    a, b = turn(g1), turn(g2)
    mid = point(*[(a[k] + b[k]) / 2 for k in "xyz"])
    return F.struct(distance(pred, a).alias("l2"), (distance(mid, pred) < 6 * (distance(a, b) + 1)).alias("success"))


def similarity_fit(src: np.ndarray, dst: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Least-squares scale, rotation and shift from src to dst, without reflection."""
    ms, md = src.mean(0), dst.mean(0)
    s, d = src - ms, dst - md
    u, sing, vt = np.linalg.svd(d.T @ s / len(src))
    flip = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    r = u * flip @ vt
    scale = float((sing * flip).sum() / s.var(0).sum())
    return scale, r, md - scale * r @ ms


def robust_similarity(src: np.ndarray, dst: np.ndarray, draws: int = 2000, limit: float = 0.3, seed: int = 0):
    """similarity_fit on the largest set of inliers that samples of three points find; the first such set wins."""
    rng, best = np.random.RandomState(seed), np.zeros(len(src), bool)
    for _ in range(draws):
        pick = rng.choice(len(src), 3, replace=False)
        scale, r, t = similarity_fit(src[pick], dst[pick])
        inside = np.linalg.norm(scale * src @ r.T + t - dst, axis=1) < limit
        if inside.sum() > best.sum():
            best = inside
    return (*similarity_fit(src[best], dst[best]), best) if best.sum() >= 3 else (*similarity_fit(src, dst), best)


def mean_rotation(rotations: np.ndarray) -> np.ndarray:
    """The rotation nearest to the mean of some."""
    u, _, vt = np.linalg.svd(rotations.mean(0))
    u[:, -1] *= np.sign(np.linalg.det(u @ vt)) or 1.0
    return u @ vt
