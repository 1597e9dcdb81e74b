"""Models as tables: recorded outputs, a function, or nothing at all.

A provider takes requests (DataFrame with key columns and `request`) and gives
them with `reply`. Recorded replies are the default; a function runs inside
mapInPandas with one batch at a time, retries, and a null reply where it fails.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.operators.sets import widened


@dataclass
class Recorded:
    replies: DataFrame
    keys: list[str]

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.replies.select(*self.keys, "reply"), self.keys, "left")


@dataclass
class Function:
    """setup() makes the model once for each task; the model maps a list of requests to a list of replies."""

    setup: Callable[[], Callable[[list], list]]
    attempts: int = 3
    backoff_s: float = 0.5
    #: Whether a batch that fails every time fails the job; else its replies are null, and `error` tells why.
    strict: bool = False

    def __call__(self, requests: DataFrame) -> DataFrame:
        setup, attempts, backoff, strict = self.setup, self.attempts, self.backoff_s, self.strict

        def run(batches):
            model = setup()
            for pdf in batches:
                reply, error = [None] * len(pdf), None
                for k in range(attempts):
                    try:
                        reply, error = model(pdf["request"].tolist()), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a model raises
                        if strict and k + 1 == attempts:
                            raise
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(backoff * (k + 1) if k + 1 < attempts else 0)
                yield pdf.assign(reply=pd.Series(reply, index=pdf.index, dtype=object), error=error)

        return requests.mapInPandas(run, widened(requests, reply="string", error="string"))


@dataclass
class Nothing:
    """The degraded stage: groups of one, tags as they are, no descriptions."""

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("reply", F.lit(None).cast("string"))
