"""Rows that are dealt out as small units of work, several to a task, each compared in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def in_units(laid: DataFrame, unit: list[str], each: Callable[[pa.Table], pa.RecordBatch | None], schema) -> DataFrame:
    """each(rows) of every unit, the rows that agree in the columns `unit` (no nulls). A task holds one unit at a time.

    Units cost what is compared in them, whatever their bytes, so the number of tasks is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in filter(len, batches):
            keys = [batch.column(c) for c in unit]
            new = np.any([pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in keys], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1), len(batch)]
            for start, end in zip(cuts, cuts[1:]):
                if (of := [k[int(start)] for k in keys]) != now:
                    if held and (got := each(pa.Table.from_batches(held))):
                        yield got
                    now, held = of, []
                held.append(batch.slice(start, end - start))
        if held and (got := each(pa.Table.from_batches(held))):
            yield got

    spread = int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return laid.repartition(spread, *unit).sortWithinPartitions(*unit).mapInArrow(run, schema)
