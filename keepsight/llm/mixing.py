"""Mixing sources to target weights (operator 10).

Every document gets a hash-random key. A range sort by (source, key) lays each
source out over many tasks, so a source with a third of all rows is no single
task's work; prefix sums come from running sums inside each range and totals of
the ranges before it. A source whose target is above its size is read whole as
often as it fits; the rest is cut at the exact budget, which takes the first
part of one document.

Defined cases: null text has size 0; a null source is a source of its own and
comes last; documents of size 0 take 0; sources that are empty have target 0;
repeated rows are documents of their own, as likely to be taken as others;
where every size is 0 all targets are 0; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsight.llm.tables import Table, own_columns

# Fixed values of the contract.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Prefix of the hash that orders documents; another seed gives another mix.
SEED = "mix-1:"


def ranked(rows: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """rows with rank (from 0) and, for each named column, before_<name>: its sum over the rows before, in this order.

    A range sort lays the rows out over tasks; ranks and sums inside a task get
    the totals of the tasks before it, of which there is one row each.
    """
    laid = Table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"pid": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "ranged").read()
    inside = Window.partitionBy("pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    one = {"rank": F.lit(1), **{f"before_{c}": F.col(c) for c in sums}}
    totals = laid.groupBy("pid").agg(*[F.sum(c).alias(f"_{n}") for n, c in one.items()])
    starts = totals.select("pid", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in one])
    added = {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{n}") for n, c in one.items()}
    return laid.join(starts, "pid").select(*rows.columns, *[c.alias(n) for n, c in added.items()])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    In order of cap / weight (a cap is max_epochs times a source's size), a
    source is full while its share of what the full ones before it leave is
    above its cap; from the first that isn't on, all share by weight. Only that
    first source's two sums reach the driver.
    """
    sources = Table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources").read()
    by_name = ranked(sources, [F.col("source").isNull(), F.col("source")], [])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = Table(by_name.select("source", "source_size", weight.alias("w"), (max_epochs * F.col("source_size")).alias("cap")), "weighed-sources").read()
    all_of = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    filled = Table(ranked(weighed, [F.col("cap").cast("decimal(38,12)") / F.col("w"), F.col("source").isNull(), F.col("source")], ["cap", "w"]), "filled-sources").read()
    exact = lambda c: c.cast("decimal(19,0)")
    rest, others = F.lit(all_of["size"]) - F.col("before_cap"), F.lit(all_of["w"]) - F.col("before_w")
    sharing = filled.filter(exact(rest) * exact(F.col("w")) <= exact(F.col("cap")) * exact(others))
    first = sharing.orderBy("rank").select("rank", rest.alias("rest"), others.cast("double").alias("others")).first()
    if first is None:
        return Table(filled.select("source", "source_size", F.col("cap").cast("double").alias("target")), "targets").read()
    share = (F.col("w") * F.lit(first["rest"])).cast("double") / F.lit(first["others"])
    return Table(filled.select("source", "source_size", F.when(F.col("rank") < first["rank"], F.col("cap").cast("double")).otherwise(share).alias("target")), "targets").read()


def running_sums(batches):
    """For mapInArrow over rows sorted by source and key: pid and, in each source, the words before the row within this task."""
    pid, last, total = TaskContext.get().partitionId(), ..., 0
    for batch in batches:
        if not batch.num_rows:
            continue
        source, size = batch.column("source").to_pylist(), np.array(batch.column("size").to_pylist(), np.int64)
        starts = np.array([i for i, s in enumerate(source) if (source[i - 1] if i else last) != s], np.int64)
        sums = np.concatenate([[0], np.cumsum(size)])
        base = np.full(len(size), -total, np.int64)
        for i in starts:
            base[i:] = sums[i]
        before = sums[:-1] - base
        total, last = int(before[-1] + size[-1]), source[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), pid, np.int64)), pa.array(before)], names=[*batch.schema.names, "pid", "before"])


def mix_sources(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, and source, text_key (XXH64 of the text).

    taken counts words, repeats included: whole epochs times size, and what the
    last, partial epoch takes of the document.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = Table(own_columns(docs, ["doc_id", "source", "text"]).select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.xxhash64(text).alias("text_key")), "sizes").read()
    targets = source_targets(sizes, weights, max_epochs)
    order = ["source", "key", "doc_id", "size", "text_key"]
    sums = Table(sizes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running_sums, "doc_id long, source string, size long, key string, text_key long, pid long, before long"), "running-sums").read()
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.groupBy("source", "pid").agg(F.sum("size").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = Table(ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "r.pid", "r.start", "t.source_size", "t.target"), "ranges").read()
    rows = sums.alias("s").join(placed.alias("p"), (F.col("s.pid") == F.col("p.pid")) & F.col("s.source").eqNullSafe(F.col("p.source")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("before")))
    return rows.select("s.doc_id", "s.size", "p.source_size", "p.target", (epochs * F.col("size") + part).cast("long").alias("taken"), "s.source", "s.text_key")
