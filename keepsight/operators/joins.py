"""Temporal, interval and spatial joins, as equi-joins and windows.

As-of joins are a union and one window pass, linear in their input; a key that is
too long for a task is cut into ranges of time, with a carried row across them.
Band joins go through buckets of the tolerance, so each
row meets the rows of two or three buckets and never all of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsight.functions.text import python_format
from keepsight.operators.ranges import Ranges, before, inside, with_summary


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], max_age: float | None = None, forward: bool = False, tie: str | None = None, first: bool = True, ranges: Ranges | None = None) -> DataFrame:
    """left and the latest row of right at or before its time (forward: the earliest at or after), as <value>.

    Of right rows of one time the first by `tie` wins, or the last where first is
    false; without a tie column, the first or last by their values. Without a
    match, or with one older than max_age, values are null; so are those of a
    left row without a time. ranges cut a key that is too long for one task: the
    last row of each range is carried to the ranges after it.
    """
    sign = -1 if forward else 1
    listed = [tie] if tie else values
    # The row that wins is the last one before the left row.
    turn = F.desc_nulls_first if first else F.asc_nulls_last
    number = (lambda t: sign * ranges(t)) if ranges else lambda t: F.lit(0)
    l = left.withColumns({"_t": sign * F.col(left_time), "_side": F.lit(1), "_r": number(F.col(left_time))})  # noqa: E741
    r = right.filter(F.col(right_time).isNotNull()).select(
        *keys, (sign * F.col(right_time)).alias("_t"), F.lit(0).alias("_side"), number(F.col(right_time)).alias("_r"), F.struct(F.col(right_time).alias("_rt"), *values).alias("_v"), F.struct(*listed).alias("_tie")
    )
    both = l.unionByName(r, allowMissingColumns=True)
    w = inside(keys).orderBy("_t", "_side", turn("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_here", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    if ranges:
        pick = F.min_by if first else F.max_by
        latest = r.groupBy(*keys, "_r", "_t").agg(pick("_v", "_tie").alias("_v")).groupBy(*keys, "_r").agg(F.max_by("_v", "_t").alias("_v"))
        spans = l.select(*keys, "_r").distinct().unionByName(latest, allowMissingColumns=True).groupBy(*keys, "_r").agg(F.first("_v", ignorenulls=True).alias("_v"))
        carried = spans.select(*keys, "_r", F.last("_v", ignorenulls=True).over(before(keys)).alias("_carried"))
        here = with_summary(here, carried, keys).withColumn("_here", F.coalesce("_here", "_carried"))
    fresh = F.col(left_time).isNotNull() if max_age is None else F.abs(F.col(left_time) - F.col("_here._rt")) <= max_age
    return here.select(*[F.col(c) for c in left.columns], *[F.when(fresh, F.col("_here")[v]).alias(v) for v in values])


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tolerance: float) -> DataFrame:
    """Pairs (l.*, r.*) of rows with equal keys whose times are at most tolerance apart."""
    l = left.withColumn("_b", F.explode(F.array(*[(F.floor(F.col(left_time) / tolerance) + k).cast("long") for k in (-1, 0, 1)]))).alias("l")  # noqa: E741
    r = right.withColumn("_b", F.floor(F.col(right_time) / tolerance).cast("long")).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l._b") == F.col("r._b")]
    return l.join(r, on).filter(F.abs(F.col(f"l.{left_time}") - F.col(f"r.{right_time}")) <= tolerance)


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], left_time: str, right_time: str, tolerance: float, tie: str, values: list[str]) -> DataFrame:
    """left_id and the values of the right row nearest in time within tolerance; ties go to the smallest `tie`. Rows without one are absent."""
    gap = F.abs(F.col(f"l.{left_time}") - F.col(f"r.{right_time}"))
    best = F.min_by(F.struct(gap.alias("gap"), *[F.col(f"r.{v}").alias(v) for v in values]), F.struct(gap, F.col(f"r.{tie}")))
    return band_pairs(left, right, keys, left_time, right_time, tolerance).groupBy(*[F.col(f"l.{c}").alias(c) for c in left_id]).agg(best.alias("_n")).select(*left_id, "_n.*")


def bracket_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], tie: str, ranges: Ranges | None = None) -> DataFrame:
    """left with the last right row at or before its time and the first at or after it: before_time, before_<value>, after_time, after_<value>.

    Of rows of one time the last by `tie` is before, and the first is after.
    """
    r = right.select(*keys, F.col(time).alias("_time"), *values, F.col(tie).alias("_listed"))
    out = left
    for side, forward in (("before", False), ("after", True)):
        named = r.withColumns({f"{side}_time": F.col("_time"), **{f"{side}_{v}": F.col(v) for v in values}})
        out = asof_join(out, named, keys, time, "_time", [f"{side}_time", *[f"{side}_{v}" for v in values]], forward=forward, tie="_listed", first=forward, ranges=ranges)
    return out


def interpolated(bracketed: DataFrame, time: str, value: str, max_gap: float = 12.0) -> DataFrame:
    """value at time and how it is known: observed, interpolated, nearest, before or after."""
    t0, t1, a, b, t = F.col("before_time"), F.col("after_time"), F.col(f"before_{value}"), F.col(f"after_{value}"), F.col(time)
    inside = t0.isNotNull() & t1.isNotNull()
    how = F.when(inside & (t0 == t1), "observed").when(inside & (t1 - t0 <= max_gap), "interpolated").when(inside, "nearest").when(t0.isNotNull(), "before").when(t1.isNotNull(), "after")
    at = F.when(how == "interpolated", a + (b - a) * ((t - t0) / (t1 - t0))).when(how == "nearest", F.when(t - t0 <= t1 - t, a).otherwise(b)).when(how == "after", b).otherwise(a)
    return bracketed.withColumns({value: at, "how": how})


def provenance() -> Column:
    """What an interpolated position is known from, as a phrase; over the result of interpolated()."""
    at = lambda c: F.concat(python_format(".1f")(c), F.lit(" s"))
    t0, t1 = F.col("before_time"), F.col("after_time")
    return (
        F.when(F.col("how") == "observed", F.concat(F.lit("seen at "), at(t0)))
        .when(F.col("how") == "interpolated", F.concat(F.lit("between the views at "), at(t0), F.lit(" and "), at(t1)))
        .when(F.col("how") == "nearest", F.concat(F.lit("the nearer view of those at "), at(t0), F.lit(" and "), at(t1), F.lit(", too far apart to interpolate")))
        .when(F.col("how") == "before", F.concat(F.lit("last seen at "), at(t0), F.lit(", not seen since")))
        .when(F.col("how") == "after", F.concat(F.lit("first seen at "), at(t1), F.lit(", after the question")))
    )


def closest_approach(a: DataFrame, b: DataFrame, keys: list[str], pair: list[str], time: str, pos: str, apart: Column, ranges: Ranges | None = None) -> DataFrame:
    """For each pair of tracks, apart at the rows nearest in time (first of a, then of b by pos, on ties).

    a and b have the keys that say which tracks are compared. Each row of a
    meets its neighbours in time only, before and after.
    """
    payload = [c for c in b.columns if c not in keys]
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in payload])
    values = [f"b_{c}" for c in payload]
    sides = [asof_join(a, right, keys, time, f"b_{time}", values, forward=forward, tie=f"b_{pos}", ranges=ranges) for forward in (False, True)]
    both = sides[0].unionByName(sides[1]).filter(F.col(f"b_{time}").isNotNull())
    return both.groupBy(*pair).agg(F.min_by(apart, F.struct(F.abs(F.col(time) - F.col(f"b_{time}")), F.col(pos), F.col(f"b_{pos}"))).alias("distance"))


def within_distance(a: DataFrame, b: DataFrame, keys: list[str], axes: list[str], radius: float) -> DataFrame:
    """Pairs (l.*, r.*) closer than radius, by grid cells of twice the radius, of which a row of a looks into one or two along each axis."""
    side, l, r = 2 * radius, a, b  # noqa: E741
    for i, c in enumerate(axes):
        reach = F.lit(radius * (1 + 1e-9)) + F.abs(F.col(c)) * 1e-12
        l = l.withColumn(f"_c{i}", F.explode(F.sequence(F.floor((F.col(c) - reach) / side).cast("long"), F.floor((F.col(c) + reach) / side).cast("long"))))  # noqa: E741
        r = r.withColumn(f"_c{i}", F.floor(F.col(c) / side).cast("long"))
    l, r = l.alias("l").hint("merge"), r.alias("r")  # noqa: E741
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, *[f"_c{i}" for i in range(len(axes))]]]
    squares = [(F.col(f"l.{c}") - F.col(f"r.{c}")) * (F.col(f"l.{c}") - F.col(f"r.{c}")) for c in axes]
    return l.join(r, on).filter(F.sqrt(sum(squares[1:], squares[0])) < radius)


def best_overlap(new: DataFrame, old: DataFrame, keys: list[str], new_id: list[str], value: str, pos: str, bucket: float = 3600.0) -> DataFrame:
    """For each new interval (t0, t1) the value of the old one of largest overlap, first on ties; overlaps may be as low as -1, exclusive.

    Intervals meet in buckets of time, each pair in the first that both reach;
    bucket should be about as long as they are.
    """
    spread = lambda df: df.withColumn("_first", F.floor((F.col("t0") - 1) / bucket)).withColumn("_b", F.explode(F.sequence(F.col("_first"), F.floor((F.greatest("t0", "t1") + 1) / bucket))))
    n, o = spread(new).alias("n"), spread(old).alias("o")
    overlap = F.least(F.col("n.t1"), F.col("o.t1")) - F.greatest(F.col("n.t0"), F.col("o.t0"))
    on = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in [*keys, "_b"]]
    pairs = n.join(o, on).filter((F.col("n._b") == F.greatest("n._first", "o._first")) & (overlap > -1))
    return pairs.groupBy(*[F.col(f"n.{c}").alias(c) for c in new_id]).agg(F.max_by(F.col(f"o.{value}"), F.struct(overlap, -F.col(f"o.{pos}"))).alias(value))


def observation_pairs(obs: DataFrame, keys: list[str], max_gap: float, least: float = 1e-6) -> DataFrame:
    """Pairs (a before b) of one object's observations at most max_gap seconds apart, with the distance between their positions (base) above least.

    obs: keys, pos, time_s, x, y, z. Time bands keep a long track from meeting all of itself.
    """
    side = obs.select(*keys, "pos", "time_s", "x", "y", "z")
    later = band_pairs(side, side, keys, "time_s", "time_s", max_gap).filter((F.col("l.time_s") < F.col("r.time_s")) | (F.col("l.time_s") == F.col("r.time_s")) & (F.col("l.pos") < F.col("r.pos")))
    base = F.sqrt(sum(((F.col(f"l.{a}") - F.col(f"r.{a}")) * (F.col(f"l.{a}") - F.col(f"r.{a}")) for a in "xyz"), F.lit(0.0)))
    return later.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.pos").alias("a"), F.col("r.pos").alias("b"), F.col("l.time_s").alias("ta"), F.col("r.time_s").alias("tb"), base.alias("base")).filter(F.col("base") > least)


def same_frame_pairs(objects: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Pairs (a.*, b.*) of objects of one frame, a before b; cap the frame first."""
    a, b = objects.alias("a"), objects.alias("b")
    return a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]).filter(F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))


def resolve_or(left: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """left with the value of its key in a lookup table, or the default."""
    return left.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
