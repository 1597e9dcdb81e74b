"""Aggregates of the object memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(c: Column, digits: int) -> Column:
    """Half-up rounding by scaling, which engines agree on."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def median_position(df: DataFrame, keys: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.median(a).alias(a) for a in axes])


def object_summary(df: DataFrame, keys: list[str], time: str = "time_s") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.min(time).alias("first_s"), F.max(time).alias("last_s"), *[F.median(a).alias(a) for a in "xyz"])


def dominant(df: DataFrame, keys: list[str], label: str, weight: str, pos: str) -> DataFrame:
    """The label of largest summed weight (first by pos on ties) and the others, sorted."""
    sums = df.groupBy(*keys, label).agg(F.sum(weight).alias("_w"), F.min(pos).alias("_p"))
    ranked = sums.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_w"), "_p")))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("_rn") == 1, F.col(label))).alias("primary"), F.array_sort(F.collect_list(F.when(F.col("_rn") > 1, F.col(label)))).alias("secondary"))


def motion(df: DataFrame, keys: list[str], static: float = 0.15) -> DataFrame:
    """Spread of box centres (cx, cy), displacement, mean box diagonal, and whether the object stays put."""
    diagonal = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    g = df.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "dg": diagonal}).groupBy(*keys)
    out = g.agg(F.stddev_pop("cx").alias("std_x"), F.stddev_pop("cy").alias("std_y"), F.sqrt(F.pow(F.max("cx") - F.min("cx"), 2) + F.pow(F.max("cy") - F.min("cy"), 2)).alias("displacement"), F.avg("dg").alias("_d"))
    return out.withColumn("mean_diagonal", F.when(F.col("_d") == 0, 1.0).otherwise(F.col("_d"))).drop("_d").withColumn("is_static", F.col("displacement") <= static * F.col("mean_diagonal"))


def representative(df: DataFrame, keys: list[str], score: str, pos: str, value: str) -> DataFrame:
    """The row nearest to the key's median position (to 2 digits), then of best score, then first: its `value`."""
    centre = median_position(df, keys).select(*keys, *[F.col(a).alias(f"_{a}") for a in "xyz"])
    d = F.sqrt(sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in "xyz"), F.lit(0.0)))
    return df.join(centre, keys).groupBy(*keys).agg(F.min_by(value, F.struct(quantised(d, 2), -F.col(score), F.col(pos))).alias(value))


def covisibility(df: DataFrame, keys: list[str], frame: str, object_id: str) -> DataFrame:
    """Distinct objects, and the most of them in one frame."""
    frames = df.groupBy(*keys, frame).agg(F.count_distinct(object_id).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("most_at_once"))
    return df.groupBy(*keys).agg(F.count_distinct(object_id).alias("n_objects")).join(frames, keys)


def robust_scale(pairs: DataFrame, keys: list[str], min_pairs: int = 12, min_positive: float = 0.8, max_mad_ratio: float = 1.0) -> DataFrame:
    """Metric scale of each clip from pairs (num, den, base), or the reason why there is none.

    Pairs of at least the median base count if that leaves min_pairs. The first
    estimate is the median ratio; one pass of Cauchy weights around it gives the
    scale.
    """
    w = Window.partitionBy(*keys)
    usable = pairs.filter("base > 1e-6").select(*keys, "num", "den", "base")
    # Each step is a window over the same partitions, so pairs move once.
    far = usable.withColumn("_far", F.col("base") >= F.median("base").over(w)).withColumn("_nf", F.count_if("_far").over(w))
    used = far.filter(F.col("_far") | (F.col("_nf") < min_pairs)).withColumn("_per", F.col("num") / F.col("den")).withColumn("_s0", F.median("_per").over(w))
    spread = used.withColumn("_dev", F.abs(F.col("_per") - F.col("_s0"))).withColumn("mad", 1.4826 * F.median("_dev").over(w))
    z = F.col("_dev") / F.greatest(F.lit(1e-6), F.col("mad"))
    out = spread.withColumn("_w", 1.0 / (1.0 + z * z)).groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg((F.col("_per") > 0).cast("double")).alias("positive"), F.first("_s0").alias("_s0"), F.first("mad").alias("mad"), F.sum(F.col("_w") * F.col("num")).alias("_n"), F.sum(F.col("_w") * F.col("den")).alias("_d"))
    s = F.when(F.col("_d") != 0, F.col("_n") / F.col("_d"))
    reason = (
        F.when(F.col("n_pairs") < min_pairs, "too few pairs").when(s.isNull() | (s <= 0), "scale not positive")
        .when(F.col("positive") < min_positive, "ratios of both signs").when(F.col("mad") > max_mad_ratio * F.abs(F.col("_s0")), "ratios too spread")
    )
    return out.select(*keys, "n_pairs", "positive", "mad", F.when(reason.isNull(), s).alias("scale"), reason.alias("reason"))


def pose_gate(steps: DataFrame, chunks: DataFrame, keys: list[str], max_seam: float = 0.5, min_scale: float = 0.8, max_scale: float = 1.25, max_step: float = 6.0) -> DataFrame:
    """Reasons against a pose track: seams of chunks, their scales (the first apart), steps between frames."""
    s = steps.groupBy(*keys).agg(F.max("step").alias("max_step"))
    later = F.when(F.col("chunk") > 0, F.col("scale"))
    c = chunks.groupBy(*keys).agg(F.max("seam").alias("max_seam"), F.min(later).alias("min_scale"), F.max(later).alias("max_scale"))
    j = s.join(c, keys, "full")
    reasons = F.array_compact(F.array(F.when(F.col("max_seam") > max_seam, "seam"), F.when((F.col("min_scale") < min_scale) | (F.col("max_scale") > max_scale), "scale"), F.when(F.col("max_step") > max_step, "step")))
    return j.withColumn("reasons", F.array_join(reasons, ",")).withColumn("verdict", F.when(F.col("reasons") == "", "PASS").otherwise("FAIL"))


def question_profile(q: DataFrame, options: str, category: str) -> DataFrame:
    """Questions and chance level by category, most first."""
    return q.groupBy(category).agg(F.count("*").alias("n_questions"), F.avg(1.0 / F.col(options)).alias("chance"))


def accuracy(q: DataFrame, keys: list[str], answer: str, correct: str) -> DataFrame:
    return q.groupBy(*keys).agg(F.count_if(F.col(answer).eqNullSafe(F.col(correct))).alias("n_correct"), F.count("*").alias("n_total"))
