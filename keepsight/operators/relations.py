"""Spatial-relation episodes: what was near, left of or on what, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsight.functions.geometry import RELATION_LIMITS, distance, pair_labels
from keepsight.operators.aggregates import quantised
from keepsight.operators.windows import gap_islands, top_k

GAP_S, MIN_FRAMES, PER_FRAME = 8.0, 2, 20
# Which relations are told first.
PRIORITY = {"on": 0, "under": 0, "left of": 1, "right of": 1, "in front of": 1, "behind": 1, "above": 2, "below": 2, "near": 3}


def relation_episodes(obs: DataFrame, gap: float = GAP_S, min_frames: int = MIN_FRAMES, per_frame: int = PER_FRAME, limits: dict[str, float] = RELATION_LIMITS) -> DataFrame:
    """clip, a, b, rel, t0, t1, n_frames, dist_m from observations (clip, frame, id, time_s, score, pos, cam, box).

    The best observation of each object and frame counts, and the best
    per_frame objects of a frame, so a frame's pairs are bounded. Runs of a
    relation break where neighbours are more than gap apart.
    """
    # One exchange by frame serves all three steps that follow.
    best = top_k(obs.select("clip", "frame", "id", "time_s", "score", "pos", "cam", "box").repartition("clip", "frame"), ["clip", "frame", "id"], [F.desc("score"), "pos"], 1)
    capped = top_k(best, ["clip", "frame"], [F.desc("score"), "pos"], per_frame)
    grouped = capped.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("id", "time_s", "cam", "box"))).alias("o"))
    pairs = F.flatten(F.transform("o", lambda a, i: F.transform(F.slice("o", i + 2, F.size("o")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = grouped.select("clip", F.explode(pairs).alias("p")).select("clip", "p.a", "p.b")
    labels = pair_labels(F.col("a.cam"), F.col("b.cam"), F.col("a.box"), F.col("b.box"), limits)
    seen = met.select("clip", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.time_s").alias("t"), distance(F.col("a.cam"), F.col("b.cam")).alias("dist"), F.explode(labels).alias("rel"))
    runs = gap_islands(seen, ["clip", "a", "b", "rel"], ["t", "dist"], "t", gap)
    episodes = runs.groupBy("clip", "a", "b", "rel", "island").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n_frames"), F.median("dist").alias("dist_m"))
    return episodes.filter(F.col("n_frames") >= min_frames).select("clip", "a", "b", "rel", quantised(F.col("t0"), 1).alias("t0"), quantised(F.col("t1"), 1).alias("t1"), "n_frames", quantised(F.col("dist_m"), 2).alias("dist_m"))


def relation_context(episodes: DataFrame, candidates: DataFrame, question: str, until: str, max_lines: int = 10, gap: float = GAP_S) -> DataFrame:
    """For each question the latest episode of each (a, b, rel) between its candidates, or 'on' with one of them; current ones are open.

    candidates: question, id, until. Episodes begun after `until` don't count,
    and ends are clipped to it.
    """
    ends = candidates.select(question, until, "id").distinct()
    # Met by both of its ends, an episode is between candidates: no question needs to look them up again, and only the latest leaves a task.
    met = [episodes.join(ends.withColumnRenamed("id", end), end).filter(F.col("t0") <= F.col(until)).withColumns({"t1": F.least("t1", F.col(until)), "_end": F.lit(end)}) for end in "ab"]
    own = [question, "a", "b", "rel"]
    of = ["t0", "t1", *[c for c in met[0].columns if c not in (*own, "t0", "t1", "_end")]]
    e = met[0].unionByName(met[1]).groupBy(*own).agg(F.max(F.struct(*of)).alias("_e"), F.count_if(F.col("_end") == "a").alias("_a"), F.count_if(F.col("_end") == "b").alias("_b"))
    latest = e.filter("rel = 'on' or (_a > 0 and _b > 0)").select(*own, "_e.*")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("rel")), F.lit(9))
    w = Window.partitionBy(question).orderBy(rank, F.desc("t1"), "a", "b", "rel")
    return latest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_lines).withColumn("current", F.col("t1") >= F.col(until) - gap)
