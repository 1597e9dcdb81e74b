"""Functions of the object memory at their edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepsight.functions import geometry as geo
from keepsight.functions import sequences as seq
from keepsight.functions import text as txt


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def point(x, y, z):
    return geo.point(*[F.lit(float(v)) for v in (x, y, z)])


def box(*v):
    return geo.box(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize(("azimuth", "want"), [(0, "front"), (22.4, "front"), (22.6, "front-right"), (-22.4, "front"), (-22.6, "front-left"), (180, "back"), (-180, "back"), (90, "right"), (-90, "left")])
def test_sectors(spark, azimuth, want):
    a = math.radians(azimuth)
    assert value(spark, geo.sector(F.lit(math.sin(a)), F.lit(math.cos(a)))) == want


def test_elevation_band(spark):
    assert value(spark, geo.sector_label(F.lit(0.0), F.lit(-1.0), F.lit(1.0))) == "front, above eye level"
    assert value(spark, geo.sector_label(F.lit(0.0), F.lit(1.0), F.lit(1.0))) == "front, below eye level"


def test_overlaps(spark):
    assert value(spark, geo.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert value(spark, geo.iou(box(0, 0, 1, 1), box(1, 1, 2, 2))) == 0
    assert value(spark, geo.iou(box(1, 1, 1, 1), box(1, 1, 1, 1))) == 0
    assert value(spark, geo.containment(box(0, 0, 4, 4), box(1, 1, 2, 2))) == 1
    assert value(spark, geo.horizontal_overlap(box(0, 0, 2, 1), box(1, 0, 5, 1))) == 0.5


def test_relations(spark):
    far = box(500, 0, 510, 10)
    labels = lambda a, b, ba=far, bb=box(0, 0, 10, 10): set(value(spark, geo.pair_labels(point(*a), point(*b), ba, bb)))
    assert labels((-1, 0, 2), (0, 0, 2)) == {"left of", "near"}
    assert labels((0, 0, 5), (0, 0, 2)) == {"behind"}
    assert labels((0, -0.5, 2), (0, 0, 2)) == {"above", "near"}
    assert labels((0, -0.5, 2), (0, 0, 2), box(0, -9, 10, 1)) == {"on", "near"}
    assert labels((3, 3, 9), (0, 0, 2)) == {"below", "behind"}
    for a, b in geo.INVERSE.items():
        assert value(spark, geo.inverse_relation(F.lit(a))) == b


def test_point_score_of_stored_predictions(spark):
    got = value(spark, geo.point_score(point(1, -2, 3), point(2, 1, 3), point(2, 1, 4)))
    assert got["l2"] == pytest.approx(0) and got["success"]


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_similarity_fits():
    rng = np.random.default_rng(1)
    src, r, t = rng.normal(size=(40, 3)), rotation(rng), np.array([1.0, -2, 3])
    dst = 2.2 * src @ r.T + t
    scale, fit, shift = geo.similarity_fit(src, dst)
    assert scale == pytest.approx(2.2) and np.allclose(fit, r) and np.allclose(shift, t)
    dst[:12] += rng.normal(size=(12, 3)) * 5
    scale, fit, shift, inside = geo.robust_similarity(src, dst)
    assert scale == pytest.approx(2.2) and np.allclose(fit, r) and inside.sum() == 28
    assert np.allclose(geo.mean_rotation(np.stack([r, r, r])), r)


@pytest.mark.parametrize(("text", "want"), [("01:02:03.5", 3723.5), ("2:03", 123.0), ("7", 7.0), ("x", None), ("1:2:3:4", None), ("", None)])
def test_hms(spark, text, want):
    assert value(spark, txt.hms_seconds(F.lit(text))) == want


def test_markup(spark):
    q = F.lit("What is the object identified by <BBOX 842.393 688.356 953.108 796.663> at <TIME 00:02:31.667 video 1>?")
    m = value(spark, txt.parse_markup(q))
    assert m["time_s"] == pytest.approx(151.667) and list(m["box"]) == [688.356, 842.393, 796.663, 953.108]
    assert value(spark, txt.plain_question(q)) == "What is the object the marked object at 00:02:31.667?"
    none = value(spark, txt.parse_markup(F.lit("<BBOX 1 2 3 4> without a time")))
    assert none["time_s"] is None and none["box"] is None


@pytest.mark.parametrize(("text", "n", "want"), [("REASONING x\nANSWER\nB\n", 5, "B"), ("ANSWER: D", 5, "D"), ("ANSWER: D", 3, None), ("so it is (c)", 5, "C"), ("option 2", 5, "C"), ("nothing", 5, None)])
def test_replies(spark, text, n, want):
    assert value(spark, txt.parse_reply(F.lit(text), F.lit(n))) == want


def test_labels_and_tags(spark):
    assert value(spark, txt.normalise_label(F.lit("<think>hm</think> In the Kitchen, near a sink and more\nx"))) == "kitchen near a sink"
    assert value(spark, txt.normalise_label(F.lit("..."))) == "unknown"
    assert value(spark, txt.clean_tags(F.lit("- red mug, Chair;1. table lamp\nhere are more, a, it's, one two three four five"))) == ["red mug", "chair", "table lamp"]
    assert value(spark, txt.terms(F.lit("The red mug, the RED chair and I"))) == ["red", "mug", "chair"]
    assert value(spark, txt.pair_phrases(F.lit("Which is closer: the red mug or the lamp?"))) == ["the red mug", "the lamp"]
    assert value(spark, txt.parse_id(F.lit('x {"id": 4} y'))) == 4 and value(spark, txt.parse_id(F.lit("no"))) == -1


def test_python_numbers(spark):
    df = spark.createDataFrame([(0.125,), (0.5,), (2.675,), (None,)], "x double")
    assert [r[0] for r in df.select(txt.python_format(".2f")("x")).collect()] == ["0.12", "0.50", "2.67", None]
    assert [r[0] for r in df.select(txt.python_round(2)("x")).collect()] == [0.12, 0.5, 2.67, None]


def test_even_indices(spark):
    for n, m in ((0, 6), (1, 6), (6, 6), (7, 6), (399, 80), (100, 12), (33, 8)):
        want = sorted({*map(int, np.linspace(0, n - 1, m).astype(int))}) if n > m else list(range(n))
        assert value(spark, seq.even_indices(F.lit(n), m)) == want


def plain_threshold(points, limit):
    out, seg, members = [], -1, []
    for p in points:
        if not members or math.dist(p, np.mean(members, axis=0)) > limit:
            seg, members = seg + 1, []
        members.append(p)
        out.append(seg)
    return out


def plain_persistent(points, limit, k):
    out, seg, members, pending = [-1] * len(points), 0, [], []
    for i, p in enumerate(points):
        if not members or math.dist(p, np.mean([points[j] for j in members], axis=0)) <= limit:
            members.append(i)
            pending = []
        else:
            pending.append(i)
            if len(pending) == k:
                seg, members, pending = seg + 1, pending, []
        for j in members:
            out[j] = seg if out[j] < 0 else out[j]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_segments_equal_sequential_twins(spark, seed):
    rng = np.random.default_rng(seed)
    points = np.cumsum(rng.normal(size=(120, 3)) * rng.choice([0.05, 1.0], (120, 1), p=[0.8, 0.2]), axis=0).tolist()
    df = spark.createDataFrame([([tuple(p) for p in points],)], "p array<struct<x:double,y:double,z:double>>")
    assert df.select(seq.threshold_segments(F.col("p"), 0.8)).first()[0] == plain_threshold(points, 0.8)
    for k in (1, 2, 3):
        assert df.select(seq.persistent_segments(F.col("p"), 0.8, k)).first()[0] == plain_persistent(points, 0.8, k)


def test_jitter_then_move(spark):
    x = [0, 0, 5, 0, 5, 5, 5, 5]
    df = spark.createDataFrame([([(float(v), 0.0, 0.0) for v in x],)], "p array<struct<x:double,y:double,z:double>>")
    assert df.select(seq.persistent_segments(F.col("p"), 1.0, 3)).first()[0] == [0, 0, -1, 0, 1, 1, 1, 1]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=3))
def test_world_and_camera_are_inverse(spark, xyz):
    row = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r, t = F.array(row(0.6, 0, -0.8), row(0, 1, 0), row(0.8, 0, 0.6)), point(1, 2, 3)
    got = value(spark, geo.to_camera(r, t, geo.to_world(r, t, point(*xyz))))
    assert list(got) == pytest.approx(xyz, abs=1e-9)
