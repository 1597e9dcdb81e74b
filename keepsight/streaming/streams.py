"""The same operators over streams.

Rows may come in any order. Those later than the watermark (two grid steps, if
not given) are dropped, which is the only difference from the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "8 seconds"


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "8 seconds", watermark: str | None = WATERMARK, min_rows: int = 1) -> DataFrame:
    """Runs of events of a key whose neighbours are at most gap apart."""
    timed = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    s = timed.groupBy(F.session_window(ts, gap).alias("_s"), *keys).agg(F.count("*").alias("n"))
    return s.filter(F.col("n") >= min_rows).select(*keys, F.col("_s.start").alias("t0"), (F.col("_s.end") - F.expr(f"INTERVAL {gap}")).alias("t1"), "n")


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, watermark: str | None = WATERMARK, **aggregates: Column) -> DataFrame:
    """Tumbling or sliding windows."""
    timed = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed.groupBy(w.alias("_w"), *keys).agg(*[c.alias(k) for k, c in aggregates.items()]).select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggregates)


ROW = np.dtype([("pos", "<i8"), *[(c, "<f8") for c in ("score", "x", "y", "z", "x1", "y1", "x2", "y2")]])


class Associator(StatefulProcessor):
    """Links the observations of a (clip, tag) as the batch operators do: suppression inside the frame, then association with the clusters so far.

    State: the rows of each frame that isn't over yet, and of each cluster its
    last position and time. An event-time timer ends a frame once the watermark
    has passed it, so its rows may come in any order and over any micro-batches;
    frames are linked in order. A cluster that nothing has touched for ttl_ms of
    event time goes. Rows of a frame share their time.
    """

    def __init__(self, radius: float, limit: float | None, ttl_ms: int | None):
        self.radius, self.limit, self.ttl_ms = radius, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "frame long", "at long, rows binary")
        self.clusters = handle.getMapState("clusters", "cluster int", "x double, y double, z double, at long")
        self.next = handle.getValueState("next", "n int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.clusters.updateValue((int(r.cluster),), (float(r.x), float(r.y), float(r.z), int(r.at_ms)))
        self.next.update((int(initialState["cluster"].max()) + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for frame, g in pdf.groupby("frame", sort=True):
                new = np.zeros(len(g), ROW)
                for c in ROW.names:
                    new[c] = g[c].to_numpy()
                held = self.frames.getValue((int(frame),)) if self.frames.containsKey((int(frame),)) else None
                at = int(g["at_ms"].max())
                if held is None or held[0] < at:
                    self.handle.registerTimer(at)
                self.frames.updateValue((int(frame),), (max(at, held[0]) if held else at, (bytes(held[1]) if held else b"") + new.tobytes()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], v[0], bytes(v[1])) for k, v in self.frames.iterator() if v[0] <= over)
        if not due:
            return
        known = {k[0]: v for k, v in self.clusters.iterator()}
        n = self.next.get()[0] if self.next.exists() else 0
        out = []
        for frame, at, rows in due:
            self.frames.removeKey((frame,))
            if self.ttl_ms is not None:
                for c in [c for c, v in known.items() if at - v[3] > self.ttl_ms]:
                    self.clusters.removeKey((c,))
                    del known[c]
            now = kept_rows(np.frombuffer(rows, ROW), self.limit)
            ids = sorted(known)
            linked = nearest_links(now, np.array([known[c][:3] for c in ids], float).reshape(-1, 3), self.radius)
            for i, p in enumerate(now):
                if i not in linked:
                    ids.append(n)
                    n += 1
                c = ids[linked.get(i, len(ids) - 1)]
                known[c] = (float(p["x"]), float(p["y"]), float(p["z"]), at)
                self.clusters.updateValue((c,), known[c])
                out.append((*key, frame, int(p["pos"]), c))
        self.next.update((n,))
        yield pd.DataFrame(out, columns=["clip", "tag", "frame", "pos", "cluster"]).astype({"cluster": np.int32})

    def close(self) -> None:
        pass


def kept_rows(rows: np.ndarray, limit: float | None) -> np.ndarray:
    """Rows of a frame by score, then pos, without those whose box a better one overlaps by limit at least, and without those that have no position."""
    rows = rows[np.lexsort((rows["pos"], -rows["score"]))]
    if limit is not None:
        kept: list[int] = []
        for i, r in enumerate(rows):
            if all(box_iou(rows[k], r) < limit for k in kept):
                kept.append(i)
        rows = rows[kept]
    return rows[~np.isnan(rows["x"] + rows["y"] + rows["z"])]


def box_iou(a, b) -> float:
    inter = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) * max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
    both = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return inter / both if inter > 0 and both > 0 else 0.0


def nearest_links(now: np.ndarray, last: np.ndarray, radius: float) -> dict[int, int]:
    """The cluster of each row that gets one: nearest pairs first, each row and each cluster once."""
    points = np.stack([now["x"], now["y"], now["z"]], axis=1) if len(now) else np.empty((0, 3))
    d = np.linalg.norm(points[:, None] - last[None], axis=2)
    det, clu = np.nonzero(d < radius)
    out: dict[int, int] = {}
    taken = set()
    for k in np.lexsort((clu, det, d[det, clu])):
        i, c = int(det[k]), int(clu[k])
        if i not in out and c not in taken:
            out[i] = c
            taken.add(c)
    return out


def associate_stream(obs: DataFrame, ts: str, radius: float = 1.0, limit: float | None = None, ttl_ms: int | None = None, watermark: str = WATERMARK, initial: DataFrame | None = None) -> DataFrame:
    """suppress() (with a limit) and associate() over a stream of (clip, tag, frame, pos, score, x, y, z, x1, y1, x2, y2) with event time ts.

    Rows later than the watermark are dropped, and a frame comes out once the
    watermark has passed it. initial: clusters of a batch (clip, tag, cluster, x,
    y, z, at_ms) to go on from.
    """
    timed = obs.withWatermark(ts, watermark).withColumn("at_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    numbers = [F.col(c).cast("double").alias(c) if c in obs.columns else F.lit(None).cast("double").alias(c) for c in ROW.names[1:]]
    rows = timed.select("clip", "tag", F.col("frame").cast("long").alias("frame"), F.col("pos").cast("long").alias("pos"), *numbers, "at_ms", ts)
    state = initial.groupBy("clip", "tag") if initial is not None else None
    return rows.groupBy("clip", "tag").transformWithStateInPandas(Associator(radius, limit, ttl_ms), "clip string, tag string, frame long, pos long, cluster int", "Append", "EventTime", initialState=state)


class LatestRow(StatefulProcessor):
    """Keeps the latest row of a key, until the watermark is ttl_ms past it."""

    def __init__(self, columns: list[str], values: str, ttl_ms: int):
        self.columns, self.values, self.ttl_ms = columns, values, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long, " + self.values)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        order = ["at_ms", *self.columns]
        top = pdf.sort_values(order, kind="stable").iloc[-1]
        new = (int(top["at_ms"]), *[None if pd.isna(top[c]) else getattr(top[c], "item", lambda v=top[c]: v)() for c in self.columns])
        old = tuple(self.last.get()) if self.last.exists() else None
        if old is not None and [(v is not None, v) for v in old] >= [(v is not None, v) for v in new]:
            return
        if old is not None:
            self.handle.deleteTimer(old[0] + self.ttl_ms)
        self.handle.registerTimer(new[0] + self.ttl_ms)
        self.last.update(new)
        yield pd.DataFrame([(*key, *new)], columns=[*pdf.columns[: len(key)], "at_ms", *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_view(observations: DataFrame, ts: str, keys: list[str], values: list[str], watermark: str = WATERMARK, ttl_ms: int = 3_600_000) -> DataFrame:
    """The latest row of each key so far, at each change; of rows of one time the largest by values.

    On a stream (for update output) a key's state goes once the watermark is
    ttl_ms past its last row, so the state holds the keys of that time, not all
    there ever were. A batch gives the last state of each key.
    """
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    if not observations.isStreaming:
        return observations.groupBy(*keys).agg(F.max_by(F.struct(ts, *values), F.struct(at.alias("at_ms"), *values)).alias("last")).select(*keys, "last.*")
    kinds = {f.name: f.dataType.simpleString() for f in observations.schema}
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in values)
    rows = observations.withWatermark(ts, watermark).select(*keys, at.alias("at_ms"), *values, ts)
    out = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "at_ms long", columns])
    latest = rows.groupBy(*keys).transformWithStateInPandas(LatestRow(values, columns, ttl_ms), out, "Update", "EventTime")
    return latest.select(*keys, F.timestamp_millis("at_ms").alias(ts), *values)
