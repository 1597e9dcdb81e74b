"""Operators against sequential twins and small hand-made cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsight.operators import aggregates, checks, joins, places, poses, ranking, relations, resolve, sets, snapshots, windows


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_asof_keeps_the_latest_and_expires(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, 9.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a", 2), (1, 2.0, "c", 0), (1, 2.0, "b", 1)], "k int, rt double, v string, pos int")
    for first, v in ((True, "c"), (False, "b")):
        assert rows(joins.asof_join(left, right, ["k"], "t", "rt", ["v"], tie="pos", first=first).fillna("-"), "k", "t", "v") == [(1, 0.5, "-"), (1, 2.0, v), (1, 9.0, v), (2, 1.0, "-")]
    assert rows(joins.asof_join(left, right, ["k"], "t", "rt", ["v"], max_age=5.0).fillna("-"), "t", "v")[-1] == (9.0, "-")
    assert rows(joins.asof_join(left, right, ["k"], "t", "rt", ["v"], forward=True).fillna("-"), "k", "t", "v")[0] == (1, 0.5, "a")


def test_nearest_ties_go_to_the_first(spark):
    left = spark.createDataFrame([(1, 10.0)], "k int, t double")
    right = spark.createDataFrame([(1, 8.0, 0), (1, 12.0, 1), (1, 4.0, 2)], "k int, rt double, pos int")
    assert rows(joins.nearest_join(left, right, ["k"], ["k", "t"], "t", "rt", 6.0, "pos", ["pos"]), "pos", "gap") == [(0, 2.0)]
    assert joins.nearest_join(left, right, ["k"], ["k", "t"], "t", "rt", 1.0, "pos", ["pos"]).count() == 0


def test_bracket_provenance(spark):
    obs = spark.createDataFrame([(1, 0.0, 0.0, 0), (1, 10.0, 10.0, 1), (1, 40.0, 50.0, 2)], "k int, t double, x double, pos int")
    ask = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 5.0, 25.0, 26.0, 99.0)], "k int, t double")
    got = joins.interpolated(joins.bracket_join(ask, obs, ["k"], "t", ["x"], "pos"), "t", "x")
    assert rows(got, "t", "how", "x") == [(-1.0, "after", 0.0), (0.0, "observed", 0.0), (5.0, "interpolated", 5.0), (25.0, "nearest", 10.0), (26.0, "nearest", 50.0), (99.0, "before", 50.0)]


@pytest.mark.parametrize(("gap", "islands"), [(8.0, 1), (8.1, 2)])
def test_gap_is_inclusive(spark, gap, islands):
    df = spark.createDataFrame([(1, 0.0), (1, gap)], "k int, t double")
    assert windows.gap_islands(df, ["k"], ["t"], "t", 8.0).select("island").distinct().count() == islands


def plain_majority(labels, half):
    out = []
    for i, own in enumerate(labels):
        near = labels[max(0, i - half) : i + half + 1]
        counts = Counter(near)
        top = max(counts.values())
        out.append(own if len(labels) < 3 or counts[own] == top else next(x for x in near if counts[x] == top))
    return out


def test_majority_filter(spark):
    rng = random.Random(4)
    for half in (0, 1, 2):
        for labels in ("AABAA", "AB", "ABC", "AAAA", "".join(rng.choice("ABC") for _ in range(40))):
            df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "k int, i int, label string")
            got = [x for _, x in rows(windows.majority_filter(df, ["k"], ["i"], "label", half), "i", "label")]
            assert got == (plain_majority(list(labels), half) if half else list(labels))


def test_chunks_cover_and_overlap(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("i"))
    got = windows.sliding_chunks(df, F.col("i"), F.lit(100), 48, 12)
    want = [(s, i) for s in range(0, 88, 36) for i in range(s, min(100, s + 48))]
    assert rows(got, "chunk_start", "i") == want


def observations(spark, rows_):
    return spark.createDataFrame(rows_, "clip string, tag string, frame long, pos long, score double, x double, y double, z double")


def test_same_frame_objects_stay_apart(spark):
    two = [("c", "chair", f, 2 * f + k, 1.0 - k / 10, float(k), 0.0, 0.0) for f in range(10) for k in range(2)]
    got = resolve.associate(observations(spark, two), ["clip", "tag"], radius=1.5)
    assert got.groupBy("frame").agg(F.count_distinct("cluster").alias("n")).filter("n <> 2").count() == 0


def test_moving_object_is_followed(spark):
    moving = [("c", "mug", f, f, 1.0, 0.5 * f, 0.0, 0.0) for f in range(20)]
    assert resolve.associate(observations(spark, moving), ["clip", "tag"]).select("cluster").distinct().count() == 1


def plain_associate(obs, radius):
    last, out = [], {}
    for f in sorted({o[2] for o in obs}):
        now = sorted((o for o in obs if o[2] == f), key=lambda o: (-o[4], o[3]))
        pairs = sorted((np.linalg.norm(np.subtract(o[5:], p)), i, c) for i, o in enumerate(now) for c, p in enumerate(last))
        used_i, used_c = set(), set()
        for d, i, c in pairs:
            if d < radius and i not in used_i and c not in used_c:
                used_i.add(i)
                used_c.add(c)
                out[now[i][3]], last[c] = c, now[i][5:]
        for i, o in enumerate(now):
            if i not in used_i:
                out[o[3]] = len(last)
                last.append(o[5:])
    return out


def test_association_equals_its_twin(spark):
    rng = np.random.default_rng(2)
    obs = [("c", "t", int(f), k, float(rng.random()), *map(float, rng.normal(size=3))) for k, f in enumerate(np.sort(rng.integers(0, 30, 150)))]
    assert rows(resolve.associate(observations(spark, obs), ["clip", "tag"]), "pos", "cluster") == sorted(plain_associate(obs, 1.0).items())


def test_streamed_sessions_equal_batch(spark, tmp_path):
    from keepsight.streaming.streams import sessions

    times = [0, 3, 8, 16, 25, 60, 61, 500]
    df = spark.createDataFrame([(1, t) for t in times], "k int, t long").withColumn("ts", F.timestamp_seconds("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["k"], min_rows=2).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("runs"), "n") == rows(sessions(df, "ts", ["k"], min_rows=2), "n") == [(2,), (4,)]


def test_suppression_is_inclusive(spark):
    b = lambda x1, x2: {"x1": x1, "y1": 0.0, "x2": x2, "y2": 1.0}
    df = spark.createDataFrame([(1, 0.9, 0, b(0.0, 10.0)), (1, 0.8, 1, b(0.0, 7.0)), (1, 0.7, 2, b(0.0, 6.9))], "f int, score double, pos int, box struct<x1:double,y1:double,x2:double,y2:double>")
    assert rows(resolve.suppress(df, ["f"], 0.7), "pos") == [(0,), (2,)]


def test_collapse_compares_with_the_seed_only(spark):
    objects = spark.createDataFrame([("g", 1, 0.0, [1]), ("g", 2, 1.0, [2]), ("g", 3, 2.0, [2]), ("g", 4, None, [1])], "g string, id long, first_s double, frames array<long>")
    scores = spark.createDataFrame([("g", 1, 2, 0.5, None), ("g", 1, 3, 0.3, 1.0), ("g", 1, 4, 0.9, 0.1)], "g string, a long, b long, match_iou double, distance double")
    assert rows(resolve.collapse_identities(objects, scores, ["g"]), "id", "member_of") == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_merged_tracks(spark):
    t = lambda track, frame, x2, score=1.0: ("c", track, frame, score, 0.0, 0.0, x2, 1.0)
    df = spark.createDataFrame([t("a", 1, 10.0), t("a", 2, 10.0), t("a", 3, 10.0), t("b", 2, 5.0), t("b", 4, 5.0), t("d", 9, 5.0)], "clip string, track string, frame long, score double, x1 double, y1 double, x2 double, y2 double")
    assert rows(resolve.merge_tracks(df, ["clip"]), "merged", "frame", "x2") == [(0, 1, 10.0), (0, 2, 5.0), (0, 3, 10.0), (0, 4, 5.0), (1, 9, 5.0)]


def scale_pairs(spark, scale, noise, seed=0):
    rng = np.random.default_rng(seed)
    points, cams = rng.normal(size=(12, 3)) * 3, np.cumsum(rng.normal(size=(20, 3)) * 0.4, axis=0)
    out = []
    for p in points:
        offset = p - cams * scale + rng.normal(size=cams.shape) * noise
        i, j = np.triu_indices(len(cams), 1)
        dc, do = cams[i] - cams[j], offset[j] - offset[i]
        out += [("c", float(n), float(d), float(b)) for n, d, b in zip((do * dc).sum(1), (dc * dc).sum(1), np.linalg.norm(dc, axis=1))]
    return spark.createDataFrame(out, "clip string, num double, den double, base double")


def test_planted_scale_is_found_and_noise_refused(spark):
    got = aggregates.robust_scale(scale_pairs(spark, 2.2, 0.05), ["clip"]).first()
    assert got["scale"] == pytest.approx(2.2, rel=0.05) and got["reason"] is None
    assert aggregates.robust_scale(scale_pairs(spark, 0.0, 3.0), ["clip"]).first()["scale"] is None


def test_snapshot_is_causal_and_idempotent(spark):
    obs = spark.createDataFrame([(1, float(t), float(t), 0.0, 0.0) for t in range(10)], "id int, time_s double, x double, y double, z double")
    at = lambda t: snapshots.snapshot_objects(obs.withColumn("u", F.lit(t)), ["id"], "u")
    assert rows(at(4.0), "n_obs", "last_s", "x") == [(5, 4.0, 2.0)]
    assert at(-1.0).count() == 0
    seg = spark.createDataFrame([(1, 0.0, None, 0.0, "early"), (1, 2.0, 9.0, 8.0, "late"), (1, 7.0, 8.0, 7.0, "after")], "id int, t0 double, t1 double, rep_s double, description string").withColumn("u", F.lit(5.0))
    assert rows(snapshots.snapshot_segments(seg, "u").fillna("-"), "t0", "t1", "description") == [(0.0, 5.0, "early"), (2.0, 5.0, "-")]


def test_snapshot_holds_no_later_positions_or_summaries(spark):
    points = spark.createDataFrame([(1, 1.0, [1.0]), (1, 3.0, [3.0]), (1, 4.0, None), (1, 8.0, [8.0]), (2, 4.0, [40.0]), (1, None, [9.0])], "id int, time_s double, world array<double>")
    seg = [(1, 0, 0.0, 2.0, 1.0, [1.5]), (1, 1, 2.0, 9.0, 8.0, [8.0]), (1, 2, 4.0, 9.0, 8.0, [7.0]), (1, 3, 6.0, 9.0, 8.0, [8.0])]
    for until, want in ((5.0, [(0, [1.5], None), (1, [3.0], None), (2, [7.0], None)]), (None, [(s[1], s[5], "all") for s in seg])):
        df = spark.createDataFrame([(*s, "d", "all", until) for s in seg], "id int, pos int, t0 double, t1 double, rep_s double, world array<double>, description string, summary string, u double")
        got = snapshots.snapshot_segments(df, "u", points, ["id"])
        assert rows(got, "pos", "world", "summary") == want and got.columns == df.columns
    with pytest.raises(ValueError):
        snapshots.snapshot_segments(df, "u")
    objects = spark.createDataFrame([(1, "s", 5.0), (2, "s", None)], "id int, summary string, u double")
    assert sorted((r["id"], r["summary"]) for r in snapshots.without_summaries(objects, "u").collect()) == [(1, None), (2, "s")]


def test_scene_segments_end_in_the_scene(spark):
    seg = [(0, None), (1, 4.0), (2, 5.0), (3, 6.0)]
    for since, want in ((5.0, [0, 2, 3]), (0.0, [0, 1, 2, 3]), (None, [0, 1, 2, 3])):
        df = spark.createDataFrame([(*s, since) for s in seg], "pos int, t1 double, since double")
        assert [r[0] for r in rows(snapshots.scene_segments(df, "since"), "pos")] == want


def test_seams(spark):
    chunks = spark.createDataFrame([("a", 0.1), ("a", 0.5), ("a", 0.2), ("a", None), ("b", None)], "clip string, rmse double")
    got = {r["clip"]: (r["seam_median"], r["seam_max"]) for r in checks.seams(chunks, ["clip"]).collect()}
    assert got == {"a": (0.2, 0.5), "b": (None, None)}


def test_event_recall_counts_recents_apart(spark):
    lines = spark.createDataFrame([(1, float(t), t % 3, t) for t in range(12)], "q int, t double, hits int, pos int")
    got = [t for _, t in rows(ranking.recall_events(lines, ["q"], "t", "hits", "pos", recent=3, match=2), "q", "t")]
    assert got == [5.0, 8.0, 9.0, 10.0, 11.0]


def test_relation_context_keeps_pairs_of_candidates_and_single_sided_on(spark):
    e = spark.createDataFrame([(1, 2, "near", 0.0, 4.0), (1, 2, "near", 8.0, 9.0), (1, 9, "near", 0.0, 1.0), (1, 9, "on", 0.0, 20.0), (1, 2, "left of", 50.0, 60.0)], "a long, b long, rel string, t0 double, t1 double")
    c = spark.createDataFrame([("q", 1, 10.0), ("q", 2, 10.0)], "q string, id long, until double")
    got = relations.relation_context(e, c, "q", "until")
    assert rows(got, "rank", "a", "b", "rel", "t0", "t1", "current") == [(1, 1, 9, "on", 0.0, 10.0, True), (2, 1, 2, "near", 8.0, 9.0, True)]


def test_relation_episodes(spark):
    cam = lambda x: {"x": x, "y": 0.0, "z": 2.0}
    b = {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}
    obs = [("c", f, i, 4.0 * f, 1.0, 10 * f + i, cam(0.5 * i), b) for f in (0, 1, 2, 9) for i in (0, 1)]
    df = spark.createDataFrame(obs, "clip string, frame long, id long, time_s double, score double, pos long, cam struct<x:double,y:double,z:double>, box struct<x1:double,y1:double,x2:double,y2:double>")
    assert rows(relations.relation_episodes(df), "a", "b", "rel", "t0", "t1", "n_frames", "dist_m") == [(0, 1, "left of", 0.0, 8.0, 3, 0.5), (0, 1, "near", 0.0, 8.0, 3, 0.5)]


def test_places(spark):
    frames = spark.createDataFrame([("c", float(i), x) for i, x in enumerate("AABAACC")], "clip string, t double, label string")
    v = places.visits(frames, ["clip"], "t", "label")
    assert rows(v, "label", "t0", "t1", "n_frames", "place_id") == [("A", 0.0, 4.0, 5, 0), ("C", 5.0, 6.0, 2, 1)]
    assert rows(places.places(v, ["clip"], "label"), "label", "n_visits", "n_frames") == [("A", 1, 5), ("C", 1, 2)]


def test_groups_are_repaired(spark):
    g = spark.createDataFrame([("mug", 1, 0), ("cup", 1, 1), ("mug", 2, 2), ("ghost", 2, 3)], "tag string, grp long, pos int")
    v = spark.createDataFrame([("mug",), ("cup",), ("lamp",)], "tag string")
    assert rows(sets.repaired_groups(g, v, "tag", "grp", "pos"), "tag", "grp") [::2] == [("cup", 1), ("mug", 1)]
    alone = dict(rows(sets.repaired_groups(g, v.union(spark.createDataFrame([("pen",)], "tag string")), "tag", "grp", "pos"), "tag", "grp"))
    assert alone["lamp"] < 0 and alone["pen"] < 0 and alone["lamp"] != alone["pen"]


def test_chained_chunks_recover_a_track(spark):
    rng = np.random.default_rng(3)
    track, out = np.cumsum(rng.normal(size=(60, 3)), axis=0), []
    for start in range(0, 50, 15):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q, s, t = (q * np.sign(np.linalg.det(q)), 1.0, np.zeros(3)) if start else (np.eye(3), 1.0, np.zeros(3))
        s, t = (rng.uniform(0.5, 2), rng.normal(size=3)) if start else (1.0, np.zeros(3))
        out += [("c", start, f, *map(float, s * q @ track[f] + t)) for f in range(start, min(60, start + 25))]
    got = poses.chain_chunks(spark.createDataFrame(out, "clip string, chunk int, frame int, x double, y double, z double"), ["clip"])
    assert np.allclose([r[1:] for r in rows(got, "frame", "x", "y", "z")], track)
    anchors = spark.createDataFrame([("c", f, *map(float, 3 * track[f] + 1)) for f in range(0, 60, 4)], "clip string, frame int, ax double, ay double, az double")
    moved = poses.anchor_track(got.select("clip", "frame", "x", "y", "z"), anchors, ["clip"])
    assert np.allclose([r[1:] for r in rows(moved, "frame", "x", "y", "z")], 3 * track + 1)


def test_even_tracks_stay_bounded(spark):
    df = spark.range(1000).select(F.lit("c").alias("k"), F.col("id"))
    assert windows.even_sample(df, ["k"], ["id"], 12).count() == 12


def test_budget_of_needed_frames(spark):
    need = spark.createDataFrame([("c", f) for f in range(5)], "k string, f long")
    rest = spark.createDataFrame([("c", f) for f in range(3, 40)], "k string, f long")
    assert sets.kept_and_sampled(need, rest, ["k"], "f", 10).count() == 10
    assert sets.kept_and_sampled(need, rest, ["k"], "f", 5).count() == 40


def test_frame_sets_as_bitmaps(spark):
    rng = random.Random(9)
    seen = [(i, rng.choice((-65, -64, -1, 0, 63, 64, rng.randint(-300, 300)))) for i in range(12) for _ in range(30)] + [(3, None), (20, None), (21, 63)]
    pairs = [(a, b) for a in range(22) for b in range(a)] + [(1, 0)]
    frames = {i: {f for k, f in seen if k == i and f is not None} for i in range(22)}
    s, p = spark.createDataFrame(seen, "id long, frame long"), spark.createDataFrame(pairs, "a long, b long")
    want = sorted((a, b, len(frames[a] & frames[b])) for a, b in set(pairs) if frames[a] & frames[b])
    assert rows(sets.common_frames(p, s, "a", "b", "id", "frame"), "a", "b", "n_common") == want
    assert rows(sets.without_common_frames(p, s, "a", "b", "id", "frame"), "a", "b") == sorted((a, b) for a, b in pairs if not frames[a] & frames[b])
    masks = sets.frame_masks(s, ["id"], "frame")
    assert masks.count() < s.distinct().count() and masks.agg(F.sum(F.bit_count("mask"))).first()[0] == s.dropna().distinct().count()


def test_pairs_of_near_objects_never_move(spark, tmp_path):
    """Frames go with the objects, so pairs are compared where they are made: nothing is shuffled after the join that makes them."""
    from keepsight.plans import queries

    rows = [(i, 3_600_000_000 * (i // 6 % 9), i % 6, "view", 10.0 * (i % 6 // 3), '{"k": 5}') for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string")
    e.select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("frames_in_common", "frame_disjoint"):
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")], plan
    got = queries.QUERIES["frames_in_common"](spark, str(tmp_path)).collect()
    seen = {u: {r[1] for r in rows if r[2] == u} for u in range(6)}
    assert got and all(r["n_common"] == len(seen[r["a"]] & seen[r["b"]]) for r in got)


def test_near_objects_meet_as_bitmaps_in_blocks(spark, tmp_path):
    """Near pairs by shared frames, whatever the blocks, across cells, without positions or frames, far and negative frames; a crowd in one place is never a join's rows."""
    import random

    from keepsight.operators import sets
    from keepsight.plans import queries

    rng = random.Random(9)
    where = {i: tuple(round(rng.uniform(-0.12, 0.12), 2) for _ in range(3)) for i in range(150)} | {150: (None, 0.0, 0.0), 151: (float("nan"), 0.0, 0.0), 152: (7.0, 7.0, 7.0)}
    frames = {i: set(rng.sample([*range(-70, 90), 10**9], rng.choice((0, 1, 4, 12)))) for i in where}
    objects = spark.createDataFrame([(i, *p) for i, p in where.items()], "id long, x double, y double, z double")
    seen = spark.createDataFrame([(i, f) for i, fs in frames.items() for f in [*fs, *fs]] + [(3, None)], "id long, frame long")
    near = [(i, j, len(frames[i] & frames[j])) for i in range(150) for j in range(i + 1, 150) if sum((p - q) * (p - q) for p, q in zip(where[i], where[j])) ** 0.5 < 0.05]
    for block in (2048, 13, 1):
        args = objects, seen, "id", "frame", ["x", "y", "z"], 0.05
        assert sorted(map(tuple, sets.near_frame_pairs(*args, True, block).collect())) == [p for p in near if p[2]]
        assert sorted(map(tuple, sets.near_frame_pairs(*args, False, block).collect())) == [p[:2] for p in near if not p[2]]
    rows = [(7 * i, 3_600_000_000 * (i // 300), i % 300, "view", 10.0, '{"k": 5}') for i in range(600)]
    e = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string")
    e.select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    crowd = queries.QUERIES["frames_in_common"](spark, str(tmp_path))
    plan = crowd._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join"), plan
    assert crowd.count() == 300 * 299 // 2


def test_nearest_first_takes_pairs_as_a_sort_of_all_would(monkeypatch):
    """Ties go by detection, then cluster, also where many points are equal; a crowd is matched without all its pairs."""

    def plain(now, last, radius):
        d = np.linalg.norm(now[:, None] - last[None], axis=2)
        det, clu = np.nonzero(d < radius)
        out = np.full(len(now), -1)
        for k in np.lexsort((clu, det, d[det, clu])):
            if out[det[k]] < 0 and clu[k] not in out:
                out[det[k]] = clu[k]
        return out

    rng = np.random.default_rng(5)
    for k in range(60):
        now, last = (np.round(rng.random((n, 3)) * 3, 1) if k % 2 else rng.integers(0, 3, (n, 3)) / 2 for n in rng.integers(0, 50, 2))
        assert (resolve.nearest_first(now, last, 1.0) == plain(now, last, 1.0)).all()
    pushed = []
    monkeypatch.setattr(resolve, "heappush", lambda heap, x: pushed.append(x) or heap.append(x) or heap.sort())
    now, last = np.zeros((300, 3)) + np.arange(300)[:, None] * 1e-3, np.zeros((300, 3)) + np.arange(300)[:, None] * 1e-3
    assert (resolve.nearest_first(now, last, 1.0) == np.arange(300)).all() and len(pushed) <= 600


def test_seeds_of_many_tags_run_without_a_group_each(spark):
    rng = random.Random(4)
    rows = [(c, f"t{t}", f, i, rng.random(), *(x := [rng.choice((0.0, 4.0, 30.0))] * 2), x[0] + 10, x[1] + 9) for i, (c, t, f) in enumerate((c, t, f) for c in range(20) for t in range(3) for f in (2, 0, 1, 1, 0))]
    dets = spark.createDataFrame(rows, "clip long, tag string, frame long, pos long, score double, x1 double, y1 double, x2 double, y2 double").repartition(3)
    out = resolve.cluster_seeds(dets, ["clip"], most=100)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for c, t in {r[:2] for r in rows}:
        clusters = []
        for r in sorted((r for r in rows if r[:2] == (c, t)), key=lambda r: (r[2], r[3])):
            over = [resolve.box_containment(np.array(k["last"]), np.array(r[5:])) for k in clusters]
            if over and max(over) >= 0.5:
                k = clusters[over.index(max(over))]
                k.update(last=r[5:], n=k["n"] + 1, at=r if r[4] > k["at"][4] else k["at"])
            else:
                clusters.append({"last": r[5:], "n": 1, "at": r})
        want += [(*k["at"], k["n"]) for k in clusters]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_disjoint_pairs_in_blocks(spark):
    """Blocks of a key meet each other once and themselves; objects without frames share none; far and negative frames too."""
    import random

    from keepsight.operators import sets

    rng = random.Random(6)
    objects = [(rng.randint(0, 1), i, sorted(rng.sample([*range(-70, 90), 10**9, 10**9 + 1], rng.choice((0, 1, 5, 12))))) for i in range(90)] + [(None, 200, [1]), (None, 201, [2]), (None, 202, [1, 2])]
    df = spark.createDataFrame(objects, "g long, id long, frames array<long>")
    want = sorted((str(g), i, j) for g, i, f in objects for h, j, e in objects if g == h and i < j and not set(f) & set(e))
    for block in (4096, 7, 1):
        found = sets.disjoint_pairs(df, ["g"], "id", "frames", block).collect()
        assert sorted((str(r["g"]), r["a"], r["b"]) for r in found) == want
    assert sets.disjoint_pairs(df.limit(0), ["g"], "id", "frames").count() == 0


def test_identities_collapse_as_seeds_in_turn(spark):
    """Random matches, in both orders, of objects that share frames, are far, or have no first time."""
    import random

    rng = random.Random(7)
    things = {i: (rng.choice((None, float(rng.randint(0, 20)))), set(rng.sample(range(12), rng.randint(0, 3)))) for i in range(120)}
    scores = {(a, b) if rng.random() < 0.5 else (b, a): (rng.choice((0.1, 0.3, 0.8)), rng.choice((None, 0.5, 1.0, 1.5))) for a in range(120) for b in range(a) if a // 40 == b // 40 and rng.random() < 0.15}
    left, want = sorted(things, key=lambda i: (1e9 if things[i][0] is None else things[i][0], i)), []
    while left:
        seed, rest = left[0], []
        want.append((seed, seed))
        for c in left[1:]:
            overlap, far = scores.get((seed, c), scores.get((c, seed), (0.0, None)))
            if overlap >= 0.3 and not things[seed][1] & things[c][1] and (far is None or far <= 1.0):
                want.append((c, seed))
            else:
                rest.append(c)
        left = rest
    objects = spark.createDataFrame([(1, i, t, sorted(f)) for i, (t, f) in things.items()], "g int, id long, first_s double, frames array<long>")
    pairs = spark.createDataFrame([(1, *p, *s) for p, s in scores.items()], "g int, a long, b long, match_iou double, distance double")
    found = resolve.collapse_identities(objects, pairs, ["g"]).select("id", "member_of").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_clips_are_chained_in_one_stream(spark):
    """Clips cost no group of their own, and batches may end within one: chunks of a moved and scaled copy come back, a chunk with too few shared frames is dropped."""
    import random

    from keepsight.operators import poses

    rng, rows_, want = random.Random(9), [], []
    for clip in (None, 1, 2, 3):
        track = [[rng.gauss(0, 1) for _ in "xyz"] for _ in range(30)]
        for chunk, (low, high) in enumerate(((0, 12), (8, 24), (23, 30))):
            rows_ += [(clip, chunk, f, *[v * (1 + chunk) + chunk for v in track[f]]) for f in range(low, high)]
        want += [(str(clip), f, *[round(v, 6) for v in track[f]], 0) for f in range(24)]
    rng.shuffle(rows_)
    df = spark.createDataFrame(rows_, "clip int, chunk int, frame int, x double, y double, z double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = poses.chain_chunks(df, ["clip"])
        found = [(str(r["clip"]), r["frame"], *[round(r[a], 6) + 0.0 for a in "xyz"], r["epoch"]) for r in out.collect()]
        assert poses.chain_chunks(df.limit(0), ["clip"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(found) == sorted(want)
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
