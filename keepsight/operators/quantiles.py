"""Exact percentiles of groups of any size, and sketches that merge.

A built-in median keeps a group's values in one task. Here a group is narrowed:
mergeable sketches, combined in the tasks, give BORDERS approximate quantiles;
the wanted rank lies between two of them, which an exact count of the values
below, at and between them confirms. It is one of the two, or only the values
strictly between go on, a few hundredths of the group however skewed or tied its
values are, until at most `most` are left, which one task sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.sources.shared import written

#: Cuts of a group in a round, and values that one task may hold.
BORDERS, MOST = 128, 100_000


def exact_percentiles(df: DataFrame, keys: list[str], columns: list[str], q: float = 0.5, most: int = MOST) -> DataFrame:
    """keys and, for each of columns, the percentile q of its values as Spark's percentile() defines it; nulls don't count, and null keys are a group.

    Groups without any value in a column have null there.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]))
    rows = df.select(*keys, each.alias("p")).select(*keys, "p.*").filter("_v is not null")
    group = [*keys, "_c"]
    at = F.lit(float(q)) * (F.col("_n") - 1)
    sizes = written(rows.groupBy(*group).agg(F.count("*").alias("_n")).select(*group, "_n", at.alias("_at")), "sizes")
    # A percentile lies between two ranks, which are looked for apart.
    ends = F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank")
    values = ranked_values(rows, sizes.select(*group, "_n", "_at", ends).withColumn("_of", F.col("_rank")), group, most)
    v = values.groupBy(*group).agg(F.min_by("_p", "_of").alias("_low"), F.max_by("_p", "_of").alias("_high"), F.first("_at").alias("_at"))
    part = F.col("_at") - F.floor("_at")
    p = v.select(*group, F.when(part == 0, F.col("_low")).otherwise((1 - part) * F.col("_low") + part * F.col("_high")).alias("_p"))
    return p.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == i, F.col("_p"))).alias(c) for i, c in enumerate(columns)])


def ranked_values(rows: DataFrame, wanted: DataFrame, group: list[str], most: int) -> DataFrame:
    """group, _of, _at, _p: the value of each wanted rank (_rank from 0, of _n values; _of and _at pass through)."""
    target, kept, found = [*group, "_of"], ["_at", "_rank"], []
    wanted = written(wanted, "ranks")
    few = met(rows, wanted.filter(F.col("_n") <= most).drop("_n"), group)
    rows = met(rows, wanted.filter(F.col("_n") > most).select(*target), group)
    while True:
        held = few.groupBy(*target).agg(F.sort_array(F.collect_list("_v")).alias("_vs"), *[F.first(c).alias(c) for c in kept])
        found.append(held.select(*target, "_at", F.get("_vs", F.col("_rank").cast("int")).alias("_p")))
        wanted = wanted.filter(F.col("_n") > most)
        if wanted.isEmpty():
            break
        cuts = rows.groupBy(*target).agg(F.percentile_approx("_v", [i / BORDERS for i in range(BORDERS + 1)], 100 * BORDERS).alias("_cuts"))
        place = F.floor(F.col("_rank") / F.col("_n") * BORDERS).cast("int")
        cut = lambda by: F.get("_cuts", F.greatest(F.lit(0), F.least(F.lit(BORDERS), place + by)))
        bounds = written(met(wanted, cuts, target).select(*target, *kept, cut(-1).alias("_from"), cut(2).alias("_to")), "bounds")
        near = met(rows, bounds, target)
        v, low, high = F.col("_v"), F.col("_from"), F.col("_to")
        inside = (v > low) & (v < high)
        counted = near.groupBy(*target).agg(F.count_if(v < low).alias("_below"), F.count_if(v == low).alias("_first"), F.count_if(inside).alias("_in"), F.count_if((v == high) & (v > low)).alias("_last"))
        told = written(met(bounds, counted, target).withColumn("_rank", F.col("_rank") - F.col("_below")), "counted")
        above = F.col("_rank") >= F.col("_first") + F.col("_in")
        if not told.filter((F.col("_rank") < 0) | (F.col("_rank") >= F.col("_first") + F.col("_in") + F.col("_last"))).isEmpty():
            raise ArithmeticError("an approximate percentile lies outside its error bound")
        found.append(told.filter((F.col("_rank") < F.col("_first")) | above).select(*target, "_at", F.when(above, high).otherwise(low).alias("_p")))
        wanted = told.filter((F.col("_rank") >= F.col("_first")) & ~above).select(*target, "_at", (F.col("_rank") - F.col("_first")).alias("_rank"), F.col("_in").alias("_n"))
        wanted = written(wanted, "ranks")
        between = written(met(near.filter(inside).select(*target, "_v"), wanted.select(*target, "_n", *kept), target), "between")
        few, rows = between.filter(F.col("_n") <= most), between.filter(F.col("_n") > most).select(*target, "_v")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with the columns that b has for its keys; null keys meet null keys."""
    renamed = b.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    return a.join(renamed, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]).drop(*[f"_of_{c}" for c in keys])


def sketches(df: DataFrame, keys: list[str], column: str, k: int = 200) -> DataFrame:
    """A KLL sketch of each group's values: `sketch` is a few kilobytes, whatever the group's size. Tables of sketches can be kept, and merged by merged_sketches()."""
    return df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), k).alias("sketch"))


def merged_sketches(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return kept.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentile(sketch: Column, q: float = 0.5) -> Column:
    """An approximate percentile; for k = 200 its rank is off by about 1.3 % of the group in 99 of 100 cases."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))
