"""Entity resolution: the operators that depend on their own earlier decisions.

They run as grouped maps over what may depend on each other: one tag of a clip,
or a connected component of tracks or identities. All that is independent of
order (suppression, candidates, components, numbering) stays in columns.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from math import inf, nan
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from keepsight.functions.geometry import iou
from keepsight.functions.sequences import suppressed
from keepsight.operators.components import connected_components
from keepsight.operators.ranges import Ranges
from keepsight.operators.sets import widened
from keepsight.operators.windows import gap_islands, top_k
from keepsight.sources.shared import written


def suppress(detections: DataFrame, keys: list[str], limit: float = 0.7) -> DataFrame:
    """Greedy non-maximum suppression in each frame: rows with columns score, pos, box and any others."""
    rest = [c for c in detections.columns if c not in (*keys, "score", "pos")]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), "pos", "score", *rest)))
    kept = detections.groupBy(*keys).agg(ordered.alias("_d")).withColumn("_d", suppressed(F.col("_d"), lambda a, b: iou(a["box"], b["box"]), limit))
    return kept.select(*keys, F.inline("_d")).drop("_s")


#: Places that a detection looks at before it asks for more.
K_NEAREST = 16


def nearest_first(now: np.ndarray, last: np.ndarray, radius: float, room: int = 1 << 20) -> np.ndarray:
    """The cluster of each detection, or -1: the nearest pairs of both, nearer than radius, are matched first and once; ties by detection, then cluster.

    Of each detection only its nearest pairs are made, and the next ones only if
    all of those are taken; so a crowd doesn't sort all pairs of a frame. Equal
    points are one place, whose clusters are taken in order.
    """
    took = np.full(len(now), -1, np.int64)
    if not len(now) or not len(last):
        return took
    places, of = np.unique(last, axis=0, return_inverse=True)
    by_place = np.split(np.argsort(of.reshape(-1), kind="stable"), np.cumsum(np.bincount(of.reshape(-1)))[:-1])
    left = [c[::-1].tolist() for c in by_place]  # the smallest last, to be popped
    spots, at = np.unique(now, axis=0, return_inverse=True)
    at, live, heap = at.reshape(-1), np.ones(len(places), bool), []
    lists: list = [None] * len(spots)

    def listed(wanted: np.ndarray, k: int) -> None:
        """The k nearest live places of spots, as (distances, places) in order; all within radius if there are no more."""
        alive = np.flatnonzero(live)
        step = max(1, room // max(1, len(alive)))
        for i in range(0, len(wanted), step):
            some = wanted[i : i + step]
            d = np.sqrt(sum(((spots[some, None, j] - places[None, alive, j]) ** 2 for j in (0, 1, 2)), np.zeros((len(some), len(alive)))))
            for row, spot in zip(d, some):
                near = np.flatnonzero(row < radius)
                if len(near) > k:
                    # All that tie with the k-th nearest, so that the order among them stays open to the clusters' numbers.
                    near = near[row[near] <= np.partition(row[near], k - 1)[k - 1]]
                near = near[np.argsort(row[near], kind="stable")]
                lists[spot] = [row[near].tolist(), alive[near].tolist(), 0]

    def offered(i: int) -> None:
        """Puts the best pair of detection i that is still free on the heap."""
        while True:
            ds, ps, start = lists[at[i]]
            while start < len(ds) and not live[ps[start]]:
                start += 1
            lists[at[i]][2] = start
            if start < len(ds):
                d = ds[start]
                free = [left[ps[k]][-1] for k in range(start, bisect_right(ds, d)) if live[ps[k]]]
                heappush(heap, (d, i, min(free)))
                return
            if not ds:
                return
            listed(np.array([at[i]]), K_NEAREST)

    listed(np.arange(len(spots)), K_NEAREST)
    for i in range(len(now)):
        offered(i)
    flat = of.reshape(-1)
    while heap:
        _, i, c = heappop(heap)
        p = flat[c]
        if live[p] and left[p][-1] == c:
            took[i] = c
            left[p].pop()
            live[p] = bool(left[p])
        else:
            offered(i)
    return took


def associate(obs: DataFrame, keys: list[str], radius: float = 1.0) -> DataFrame:
    """Links each tag's suppressed observations into clusters, frame by frame.

    In a frame, the nearest pairs of a detection and a cluster's last position,
    nearer than radius, are matched first and once; others open clusters. Two
    rows of a frame are never linked. Gives obs with `cluster`.
    """
    schema = widened(obs, cluster="int")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y", "z"]).sort_values(["frame", "score", "pos"], ascending=[True, False, True], kind="stable")
        out, last, n = np.zeros(len(pdf), np.int32), np.empty((max(1, len(pdf)), 3)), 0
        points, frames = pdf[["x", "y", "z"]].to_numpy(float), pdf["frame"].to_numpy()
        starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]]) if len(pdf) else []
        for s, e in zip(starts, [*starts[1:], len(pdf)]):
            now = points[s:e]
            took = nearest_first(now, last[:n], radius)
            fresh = took < 0
            took[fresh] = n + np.arange(fresh.sum())
            n += int(fresh.sum())
            out[s:e], last[took] = took, now
        return pdf.assign(cluster=out)

    return obs.groupBy(*keys).applyInPandas(link, schema)


def separate_pieces(obs: DataFrame, keys: list[str], distance: float, ranges: Ranges | None = None, rounds: int = 2) -> tuple[DataFrame, list[str]]:
    """obs cut where nothing lies between: rows of different pieces are more than distance apart along some axis. Gives obs with the columns that number the pieces."""
    pieces: list[str] = []
    for i in range(rounds):
        for axis in "xyz":
            obs = gap_islands(obs, [*keys, *pieces], [axis, "pos"], axis, distance, f"_piece{i}{axis}", ranges)
            pieces.append(f"_piece{i}{axis}")
            if ranges:  # a step reads its input several times then
                obs = written(obs, "pieces")
    return obs, pieces


def cluster_by_centroid(obs: DataFrame, keys: list[str], radius: float = 0.6, ranges: Ranges | None = None) -> DataFrame:
    """Offline clusters: best scores first, each to the nearest centroid (median of members) within radius, else its own. Rows without a position are left out.

    A centroid lies within the bounds of its members, so what is farther than
    radius from all of them along an axis can't meet it: a label is cut along its
    gaps, first by x, then each part by y, and so on, and the pieces are
    clustered apart. Clusters are numbered over the whole label by who opened
    them, as one pass over it would. ranges cut a label that is too long to sort
    in one task.
    """
    names, placed = obs.columns, obs.filter("x is not null and y is not null and z is not null and not isnan(x + y + z)")
    cut, pieces = separate_pieces(placed, keys, radius, ranges)
    cut = cut.withColumn("_piece", F.to_json(F.struct(*keys, *pieces))).drop(*pieces)
    schema = widened(cut, _local="int", _score="double", _first=cut.schema["pos"].dataType)
    out_names = schema.names

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "pos"], ascending=[False, True], kind="stable")
        members, centroids, opened, out = [], np.empty((0, 3)), [], []
        for row, p in enumerate(pdf[["x", "y", "z"]].to_numpy(float)):
            d = np.linalg.norm(centroids - p, axis=1)
            best = int(d.argmin()) if len(d) else -1
            if best >= 0 and d[best] < radius:
                for axis, v in zip(members[best], p):
                    insort(axis, v)
                half = (len(members[best][0]) - 1) // 2
                centroids[best] = [(axis[half] + axis[-1 - half]) / 2 for axis in members[best]]
            else:
                best = len(members)
                opened.append(row)
                members.append([[v] for v in p])
                centroids = np.vstack([centroids, p])
            out.append(best)
        first = pdf.iloc[[opened[k] for k in out]]
        return pdf.assign(_local=np.array(out, np.int32), _score=first["score"].to_numpy(float), _first=first["pos"].to_numpy())

    linked = written(in_buckets(cut, "_piece", lambda pdf: link(pdf)[out_names], schema), "clusters")
    opened = linked.groupBy(*keys, "_piece", "_local").agg(F.first("_score").alias("_score"), F.first("_first").alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_score"), "_first")
    numbered = opened.select((F.row_number().over(w) - 1).alias("cluster"), F.col("_piece").alias("_p"), F.col("_local").alias("_l"))
    return linked.join(numbered, F.col("_piece").eqNullSafe(F.col("_p")) & (F.col("_local") == F.col("_l"))).select(*names, "cluster")


def box_containment(a: np.ndarray, b: np.ndarray) -> float:
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return inter / least if least > 0 else 0.0


def cluster_seeds(dets: DataFrame, keys: list[str], limit: float = 0.5, most: int = 40) -> DataFrame:
    """Seeds of a clip: a detection joins the cluster of its tag whose last box it overlaps most (containment of limit at least). Gives the best-scored detection of each cluster with its support, the best `most` of a clip. Tags are clustered apart from each other."""
    schema = widened(dets, support="long")
    names, group = dets.columns, [*keys, "tag"]
    at = {c: i for i, c in enumerate(names)}
    of, box = [at[c] for c in group], [at[c] for c in ("x1", "y1", "x2", "y2")]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come group by group in order, so what is open is the clusters of one group: last box, its area, best score, row, support.
        now, clusters = None, []

        def given() -> pa.RecordBatch:
            columns = list(zip(*[(*c[3], c[4]) for c in done])) or [()] * (len(names) + 1)
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, [*kinds, pa.int64()])], names=[*names, "support"])

        done, kinds = [], []
        for batch in batches:
            kinds = batch.schema.types
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = [row[i] for i in of]
                if key != now:
                    done += clusters
                    now, clusters = key, []
                x1, y1, x2, y2 = (nan if row[i] is None else row[i] for i in box)
                area, best, most = (x2 - x1) * (y2 - y1), None, -1.0
                for c in clusters:
                    a1, b1, a2, b2 = c[0]
                    # As box_containment(): a box that can't be compared overlaps by nothing.
                    least = min(c[1], area)
                    w, h = min(a2, x2) - max(a1, x1), min(b2, y2) - max(b1, y1)
                    share = max(0.0, w) * max(0.0, h) / least if least > 0 else 0.0
                    if share > most:
                        best, most = c, share
                if best is not None and most >= limit:
                    best[0], best[1], best[4] = (x1, y1, x2, y2), area, best[4] + 1
                    if (row[score] is not None) and (best[2] is not None) and row[score] > best[2]:
                        best[2], best[3] = row[score], row
                else:
                    clusters.append([(x1, y1, x2, y2), area, row[score], row, 1])
            if done:
                yield given()
                done = []
        done = clusters
        if done:
            yield given()

    score = at["score"]
    laid = dets.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, F.asc_nulls_last("frame"), F.asc_nulls_last("pos"))
    return top_k(laid.mapInArrow(seeds, schema), keys, [F.desc("support"), F.desc("score"), "pos"], most)


def in_buckets(df: DataFrame, part: str, each, schema) -> DataFrame:
    """each(pdf) over the rows of each part; many small parts share a group, as a group of its own costs more than most parts do."""
    buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([each(g) for _, g in pdf.groupby(part, sort=False)])

    return df.withColumn("_bucket", F.pmod(F.xxhash64(part), F.lit(buckets))).groupBy("_bucket").applyInPandas(run, schema)


def in_runs(each: Callable[[list[tuple]], list[tuple]], of: list[int], schema):
    """For mapInArrow: each(rows) over runs of rows that agree in the columns `of`, as rows of schema. A run may cross batches; one is held at a time."""
    out, most = to_arrow_schema(schema), 10_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = lambda: pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(list(zip(*done)) or [()] * len(out), out)], schema=out)
        now, held, done = None, [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = [row[i] for i in of]
                if key != now:
                    if held:
                        done += each(held)
                    if len(done) >= most:
                        yield given()
                        done = []
                    now, held = key, []
                held.append(row)
        if held:
            done += each(held)
        yield given()

    return run


def overlapping_tracks(boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pairs (a, b) of tracks, as structs of keys and track, with a common frame in which their boxes overlap; found by frame and grid cell."""
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    at = boxes.select(*keys, "frame", "x1", "y1", "x2", "y2", F.struct(*keys, "track").alias("node")).withColumn("_cx", span("x1", "x2")).withColumn("_cy", span("y1", "y2"))
    l, r = at.alias("l"), at.alias("r")  # noqa: E741
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "frame", "_cx", "_cy"]]
    meet = [F.least(F.col(f"l.{h}"), F.col(f"r.{h}")) > F.greatest(F.col(f"l.{low}"), F.col(f"r.{low}")) for low, h in (("x1", "x2"), ("y1", "y2"))]
    return l.join(r, on).filter((F.col("l.node") < F.col("r.node")) & meet[0] & meet[1]).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def merge_tracks(boxes: DataFrame, keys: list[str], limit: float = 0.6, cell: float = 256.0) -> DataFrame:
    """Merges tracks of a clip whose boxes contain each other: median containment over common frames of limit at least.

    Tracks go from most frames and best score down, and each is tested with all
    after it, always as the roots of what they have been merged into: a root that
    has grown is tested again and may itself be absorbed. The earlier root keeps
    its score and takes the other's boxes, the smaller one where both have one.
    Rows: track, frame, score, x1, y1, x2, y2, one for each track and frame; empty
    boxes don't count. Gives them merged, with the number of the root in its clip
    by (frames, score).

    A merged box is always one of the given ones, and roots with a median above 0
    overlap somewhere, so only tracks that given boxes connect can ever merge:
    components of overlapping tracks are merged apart from each other.
    """
    if limit <= 0:
        raise ValueError("a limit of 0 merges tracks that never overlap")
    # Read by both sides of the pairs, the linked and the lone tracks.
    boxes = written(boxes.filter("x2 > x1 and y2 > y1"), "boxes")
    names = boxes.columns
    parts = connected_components(overlapping_tracks(boxes, keys, cell)).select(*[F.col(f"node.{c}").alias(f"_of_{c}") for c in [*keys, "track"]], F.xxhash64("component").alias("_part"))
    joined = boxes.join(parts, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "track"]], "left").drop(*parts.columns[:-1])
    linked, alone = joined.filter("_part is not null"), joined.filter("_part is null").drop("_part")
    schema = widened(boxes, _root=boxes.schema["track"].dataType, _score="double")
    at = {c: i for i, c in enumerate(names)}
    frame, track, score, box = at["frame"], at["track"], at["score"], [at[c] for c in ("x1", "y1", "x2", "y2")]

    def merge(rows: list[tuple]) -> list[tuple]:
        tracks, best = {}, {}
        for r in rows:
            t = r[track]
            tracks.setdefault(t, {})[r[frame]] = (tuple(r[k] for k in box), r)
            if r[score] is not None and r[score] == r[score] and (t not in best or r[score] > best[t]):
                best[t] = float(r[score])
        order = sorted(tracks, key=lambda t: (-len(tracks[t]), -best.get(t, -inf), t))
        root = {t: t for t in order}

        def of(t):
            while root[t] != t:
                root[t] = root[root[t]]
                t = root[t]
            return t

        area = lambda x: (x[0][2] - x[0][0]) * (x[0][3] - x[0][1])
        for k, first in enumerate(order):
            for second in order[k + 1 :]:
                ra, rb = of(first), of(second)
                a, b = tracks[ra], tracks[rb]
                if ra == rb or not (common := a.keys() & b.keys()):
                    continue
                if median([box_containment(a[f][0], b[f][0]) for f in common]) >= limit:
                    for f, x in b.items():
                        if f not in a or area(x) < area(a[f]):
                            a[f] = x
                    root[rb] = ra
        return [(*r[: len(names)], t, best.get(t)) for t in order if root[t] == t for _, r in tracks[t].values()]

    # Rows come part by part, so small parts cost no group of their own.
    laid = linked.select(*names, "_part").repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part").sortWithinPartitions("_part", *keys)
    joint = laid.mapInArrow(in_runs(merge, [len(names), *[at[k] for k in keys]], schema), schema)
    highest = F.max(F.when(~F.isnan("score"), F.col("score"))).over(Window.partitionBy(*keys, "track"))
    single = alone.withColumns({"_root": F.col("track"), "_score": highest.cast("double")})
    merged = written(joint.unionByName(single), "merged-tracks")
    roots = merged.groupBy(*keys, "_root").agg(F.count("*").alias("_n"), F.first("_score").alias("_s"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.desc("_s"), "_root")
    numbered = roots.select((F.row_number().over(w) - 1).alias("merged"), *[F.col(c).alias(f"_of_{c}") for c in [*keys, "_root"]])
    return merged.join(numbered, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_root"]]).select(*names, "merged")


def collapse_identities(objects: DataFrame, scores: DataFrame, keys: list[str], tau: float = 0.3, max_distance: float = 1.0) -> DataFrame:
    """Groups objects of one synonym group that are the same thing.

    Objects go by first time (null last). A seed takes every later object that
    shares no frame with the seed, matches its mask by tau at least, and was not
    farther than max_distance at the closest time (null passes; 0 disables).
    objects: id, first_s, frames (array); scores: a, b, match_iou, distance.
    Gives id, member_of. Only objects that matches connect can be the same, so
    components of matches are grouped apart from each other.
    """
    matched = written(scores.filter(F.col("match_iou") >= tau), "matches")
    ends = written(connected_components(matched.select(F.struct(*keys, F.col("a").alias("id")).alias("a"), F.struct(*keys, F.col("b").alias("id")).alias("b"))), "identity-parts")
    flat = ends.select(*[F.col(f"node.{c}").alias(f"_of_{c}") for c in [*keys, "id"]], F.xxhash64("component").alias("_part"))
    part = lambda df, i, how: df.join(flat, [df[c].eqNullSafe(flat[f"_of_{k}"]) for c, k in zip([*keys, i], [*keys, "id"])], how).drop(*flat.columns[:-1])
    schema = widened(objects.select(*keys, "id"), member_of=objects.schema["id"].dataType)

    def collapse(pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        match, met = dict(zip(zip(pairs["a"], pairs["b"]), zip(pairs["match_iou"], pairs["distance"]))), defaultdict(list)
        for a, b in match:
            met[a].append(b)
            met[b].append(a)
        pdf = pdf.assign(_t=pdf["first_s"].fillna(1e9)).sort_values(["_t", "id"], kind="stable")
        frames, out = {i: set(f) for i, f in zip(pdf["id"], pdf["frames"])}, {}
        # All before a seed are taken, so of those that it matches the later ones are those still free.
        for seed in pdf["id"]:
            if seed in out:
                continue
            out[seed] = seed
            for c in met[seed]:
                if c in out or c not in frames:
                    continue
                overlap, far = match.get((seed, c), match.get((c, seed), (None, None)))
                good = overlap is not None and overlap >= tau and not frames[seed] & frames[c]
                if good and (not max_distance or far is None or np.isnan(far) or far <= max_distance):
                    out[c] = seed
        return pdf[[*keys, "id"]].assign(member_of=pdf["id"].map(out))

    by = [*keys, "_part"]  # two components of one hash in a group of synonyms are still apart, as nothing matches across them
    right, placed = part(matched, "a", "inner").select(*keys, F.col("_part").alias("_p"), "a", "b", "match_iou", "distance"), part(objects, "id", "left")
    joint = placed.filter("_part is not null").groupBy(*by).cogroup(right.groupBy(*keys, "_p")).applyInPandas(collapse, schema)
    return joint.unionByName(placed.filter("_part is null").select(*keys, "id", F.col("id").alias("member_of")))
