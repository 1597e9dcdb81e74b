"""Set operators over key columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from keepsight.operators.units import in_units
from keepsight.sources.shared import written


def widened(df: DataFrame, **columns):
    """The schema of df with further columns."""
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]).schema


def still_to_do(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units without a result yet: what a resumed stage works on."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def with_partner(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def repaired_groups(groups: DataFrame, vocabulary: DataFrame, key: str, group: str, pos: str) -> DataFrame:
    """Each known word once: in the first group that names it, or in one of its own, whose negative id comes from a digest of the word."""
    known = groups.join(vocabulary.select(key), key, "left_semi")
    first = known.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(pos))).filter("_rn = 1").select(key, group)
    left = vocabulary.select(key).join(first, key, "left_anti")
    alone = left.withColumn(group, -1 - F.conv(F.substring(F.md5(F.col(key)), 1, 15), 16, 10).cast("long"))
    return first.unionByName(alone)


def frame_masks(seen: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """The set of frames of each key as bitmaps: keys, block, mask, a bit for each of the block's 64 frames. Repeated frames count once."""
    of = seen.filter(F.col(frame).isNotNull())
    return of.groupBy(*keys, F.floor(F.col(frame) / 64).alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(frame), F.lit(64)).cast("int"))).alias("mask"))


def common_frames(candidates: DataFrame, seen: DataFrame, left: str, right: str, object_id: str, frame: str) -> DataFrame:
    """left, right and n_common for the pairs of objects that share frames; blocks of frames meet, never single ones."""
    masks = frame_masks(seen, [object_id], frame)
    side = lambda name, m: masks.select(F.col(object_id).alias(name), F.col("block").alias("_b"), F.col("mask").alias(m))
    both = candidates.select(left, right).distinct().join(side(left, "_l"), left).join(side(right, "_r"), [right, "_b"])
    shared = F.col("_l").bitwiseAND(F.col("_r"))
    return both.filter(shared != 0).groupBy(left, right).agg(F.sum(F.bit_count(shared)).alias("n_common"))


def without_common_frames(candidates: DataFrame, seen: DataFrame, left: str, right: str, object_id: str, frame: str) -> DataFrame:
    """Pairs (left, right) of objects that share no frame."""
    return candidates.join(common_frames(candidates, seen, left, right, object_id, frame), [left, right], "left_anti")


def near_frame_pairs(objects: DataFrame, seen: DataFrame, object_id: str, frame: str, axes: list[str], radius: float, shared: bool, block: int = 2048) -> DataFrame:
    """Pairs (a, b), a < b, of objects closer than radius that share frames, with their number n_common; shared false: those that share none.

    objects: object_id and axes (without a position: in no pair); seen: object_id,
    frame. Objects lie in cells of twice the radius and look into those at or
    after their own, so two meet in one cell. A cell's rows are cut into blocks,
    and a task compares two of them at a time, as bitmaps of 64 frames: pairs that
    are too far apart are never rows, and those given never move.
    """
    side, cell = 2 * radius, [f"_c{i}" for i in range(len(axes))]
    words = frame_masks(seen, [object_id], frame).groupBy(F.col(object_id).alias("_of")).agg(F.collect_list(F.struct("block", "mask")).alias("_f"))
    firm = [F.col(c).isNotNull() & ~F.isnan(c) for c in axes]
    at = objects.filter(reduce(and_, firm)).join(words, F.col(object_id) == F.col("_of"), "left")
    none = F.array().cast("array<bigint>")
    placed = written(at.select(F.col(object_id).alias("_id"), *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(axes)], F.coalesce("_f.block", none).alias("_words"), F.coalesce("_f.mask", none).alias("_bits")), "placed")
    own = placed.withColumns({c: F.floor(F.col(f"_p{i}") / side).cast("long") for i, c in enumerate(cell)})
    looks = own.withColumn("_home", F.struct(*cell))
    for i, c in enumerate(cell):
        reach = F.lit(radius * (1 + 1e-9)) + F.abs(F.col(f"_p{i}")) * 1e-12
        looks = looks.withColumn(c, F.explode(F.sequence(*[F.floor((F.col(f"_p{i}") + k * reach) / side).cast("long") for k in (-1, 1)])))
    looks = looks.filter(F.struct(*cell) >= F.col("_home")).withColumn("_at_home", F.struct(*cell) == F.col("_home")).drop("_home")
    rows = looks.withColumn("_left", F.lit(True)).unionByName(own.withColumns({"_at_home": F.lit(True), "_left": F.lit(False)}))
    count = lambda left: F.ceil(F.count(F.when(F.col("_left") == left, 1)) / block)
    # Who only looks at itself, in a cell of its own, meets nobody.
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n"), count(True).alias("_ls"), count(False).alias("_rs")).filter("_n > 2 and _rs > 0")
    cut = rows.join(sizes.drop("_n"), cell).withColumn("_mine", F.pmod(F.xxhash64("_id"), F.when(F.col("_left"), F.col("_ls")).otherwise(F.col("_rs"))))
    each = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_left"), F.col("_rs")).otherwise(F.col("_ls")) - 1)))
    unit = [*cell, "_lb", "_rb"]
    laid = each.withColumns({"_lb": F.when(F.col("_left"), F.col("_mine")).otherwise(F.col("_other")), "_rb": F.when(F.col("_left"), F.col("_other")).otherwise(F.col("_mine"))})
    laid = laid.select(*unit, "_left", "_at_home", "_id", *[f"_p{i}" for i in range(len(axes))], "_words", "_bits")
    kind = objects.schema[object_id].dataType
    schema = widened(objects.select(), a=kind, b=kind, **({"n_common": "long"} if shared else {}))
    out = to_arrow_schema(schema)

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        left = rows["_left"].to_numpy()
        if left.all() or not left.any():
            return None
        l, r = rows.filter(pa.array(left)), rows.filter(pa.array(~left))  # noqa: E741
        ends = [[t[f"_p{i}"].to_numpy() for i in range(len(axes))] for t in (l, r)]
        ids, home = [t["_id"].to_numpy() for t in (l, r)], l["_at_home"].to_numpy()
        found = []
        for k in range(0, len(l), 256):
            square = None
            for p, q in zip(*ends):
                d = p[k : k + 256, None] - q[None]
                d *= d
                square = d if square is None else square + d
            near = np.sqrt(square) < radius
            mine = np.flatnonzero(home[k : k + 256])
            near[mine] &= ids[0][k : k + 256][mine, None] < ids[1][None]
            i, j = np.nonzero(near)
            found.append((i + k, j))
        i, j = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            return None
        of, to = (frame_bits(t["_words"].combine_chunks(), t["_bits"].combine_chunks()) for t in (l, r))
        n = np.zeros(len(i), np.int64)
        for w in of.keys() & to.keys():
            both = []
            for (at, bits), size in ((of[w], len(l)), (to[w], len(r))):
                mask = np.zeros(size, np.uint64)
                mask[at] = bits
                both.append(mask)
            met = both[0][i] & both[1][j]
            if shared:
                n += np.bitwise_count(met)
            else:
                i, j = i[met == 0], j[met == 0]
        if shared:
            i, j, n = i[n > 0], j[n > 0], n[n > 0]
        x, y = ids[0][i], ids[1][j]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((np.minimum(x, y), np.maximum(x, y), n), out)], schema=out)

    return in_units(laid, unit, pairs, schema)


def frame_bits(words: pa.ListArray, bits: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each 64 frames, the rows that have any of them and their bits."""
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
    flat, masks = words.flatten().to_numpy(), bits.flatten().to_numpy().view(np.uint64)
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order])) + 1
    return {int(flat[at[0]]): (row[at], masks[at]) for at in np.split(order, cuts) if len(at)}


def disjoint_pairs(objects: DataFrame, keys: list[str], object_id: str, frames: str, block: int = 4096) -> DataFrame:
    """Pairs (a, b), a < b, of a key's objects that have no frame in common.

    A key's objects lie in blocks, and two blocks meet in one task as bitmaps of
    64 frames; pairs that share a frame are never made as rows. The work is that
    of all pairs, some nanoseconds each; a task holds two blocks.
    """
    laid = objects.select(*keys, F.col(object_id).alias("_id"), F.col(frames).alias("_frames"))
    sizes = laid.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_blocks"), *[F.first(k).alias(f"_of_{k}") for k in keys]).drop(*keys)
    own = laid.join(sizes, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
    units = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select(*keys, "_id", "_frames", "_own", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"))
    kind = objects.schema[object_id].dataType
    schema = widened(objects.select(*keys), a=kind, b=kind)

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        one = pdf["_low"].iat[0] == pdf["_high"].iat[0]
        sides = [pdf] * 2 if one else [pdf[pdf["_own"] == pdf["_low"]], pdf[pdf["_own"] == pdf["_high"]]]
        (ids, words), (others, rest) = ((s["_id"].to_numpy(), frame_words(s["_frames"])) for s in sides)
        meet = np.zeros((len(ids), len(others)), bool)
        for w in words.keys() & rest.keys():
            (rows, bits), (columns, masks) = words[w], rest[w]
            for i in range(0, len(rows), 256):
                hit = (bits[i : i + 256, None] & masks[None]) != 0
                if len(columns) == len(others):
                    meet[rows[i : i + 256]] |= hit
                else:
                    meet[np.ix_(rows[i : i + 256], columns)] |= hit
        left, right = np.nonzero(~meet)
        if one:
            left, right = left[left < right], right[left < right]
        x, y = ids[left], others[right]
        return pd.DataFrame({**{k: [pdf[k].iat[0]] * len(x) for k in keys}, "a": np.minimum(x, y), "b": np.maximum(x, y)})

    return units.groupBy(*keys, "_low", "_high").applyInPandas(apart, schema)


def frame_words(frames: Iterable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each 64 frames, the rows that have any of them and their bits."""
    of = [np.asarray(f, np.int64) for f in frames]
    flat, row = np.concatenate([np.empty(0, np.int64), *of]), np.repeat(np.arange(len(of)), [len(f) for f in of])
    order = np.lexsort((row, flat >> 6))
    flat, row = flat[order], row[order]
    words, bits = flat >> 6, np.uint64(1) << (flat & 63).astype(np.uint64)
    starts = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (row[1:] != row[:-1])]) if len(flat) else np.empty(0, np.int64)
    masks, words, row = (np.bitwise_or.reduceat(bits, starts) if len(starts) else bits), words[starts], row[starts]
    cuts = np.flatnonzero(words[1:] != words[:-1]) + 1 if len(words) else []
    return {int(w[0]): (r, m) for w, r, m in zip(np.split(words, cuts), np.split(row, cuts), np.split(masks, cuts)) if len(w)}


def kept_and_sampled(need: DataFrame, optional: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """All needed frames and evenly spaced optional ones up to the budget; a budget that needs use up trims nothing."""
    from keepsight.functions.sequences import even_indices

    rest = optional.join(need, [*keys, order], "left_anti")
    room = need.groupBy(*keys).agg((F.lit(budget) - F.count("*")).cast("int").alias("_room"))
    w = Window.partitionBy(*keys)
    ranked = rest.join(room, keys, "left").withColumn("_room", F.coalesce("_room", F.lit(budget))).withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w).cast("int")})
    step = F.when(F.col("_room") > 1, (F.col("_n") - 1).cast("double") / (F.col("_room") - 1))
    picks = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_room"), F.lit(1)) - 1), lambda i: F.when(i == F.col("_room") - 1, F.col("_n") - 1).otherwise((i * F.coalesce(step, F.lit(0.0))).cast("int")))
    keep = (F.col("_room") <= 0) | (F.col("_n") <= F.col("_room")) | F.array_contains(picks, F.col("_i"))
    return need.select(*keys, order).unionByName(ranked.filter(keep).select(*keys, order))
