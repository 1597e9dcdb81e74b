"""Run-length masks in the public COCO form, by Arrow UDFs.

Counts alternate between unset and set pixels in column order. In their compact
form each count (from the third on, its difference to the one two before) is
written in groups of five bits with a continuation bit, as printable characters.
Box masks need none of this: use the box functions of geometry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def counts_of(text: str) -> list[int]:
    out: list[int] = []
    value = shift = 0
    for ch in text:
        c = ord(ch) - 48
        value |= (c & 31) << shift
        shift += 5
        if not c & 32:
            if c & 16:
                value -= 1 << shift
            out.append(value + (out[-2] if len(out) > 2 else 0))
            value = shift = 0
    return out


def text_of(counts: list[int]) -> str:
    out = []
    for i, n in enumerate(counts):
        x = n - counts[i - 2] if i > 2 else n
        while True:
            c, x = x & 31, x >> 5
            more = x != (-1 if c & 16 else 0)
            out.append(chr((c | 32 if more else c) + 48))
            if not more:
                break
    return "".join(out)


def decoded(height: int, width: int, text: str) -> np.ndarray:
    counts = counts_of(text)
    return np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape(width, height).T


def encoded(mask: np.ndarray) -> str:
    flat = mask.T.ravel()
    edges = np.flatnonzero(np.diff(flat)) + 1
    counts = np.diff(np.r_[0, edges, len(flat)]).tolist()
    return text_of([0, *counts] if len(flat) and flat[0] else counts)


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")]))
def mask_box(height: pd.Series, width: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """The box around a mask, ends exclusive; null without pixels."""
    rows = []
    for h, w, c in zip(height, width, counts):
        y, x = np.nonzero(decoded(int(h), int(w), c)) if c else ((), ())
        rows.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1) if len(x) else (None,) * 4)
    return pd.DataFrame(rows, columns=["x1", "y1", "x2", "y2"]).astype("Int64")


@F.pandas_udf(T.DoubleType())
def mask_iou(height: pd.Series, width: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Intersection over union; 0 for empty masks."""
    out = []
    for h, w, p, q in zip(height, width, a, b):
        m, n = decoded(int(h), int(w), p), decoded(int(h), int(w), q)
        union = (m | n).sum()
        out.append(float((m & n).sum() / union) if union else 0.0)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def mask_containment(height: pd.Series, width: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Intersection over the smaller mask; 0 if one is empty."""
    out = []
    for h, w, p, q in zip(height, width, a, b):
        m, n = decoded(int(h), int(w), p), decoded(int(h), int(w), q)
        least = min(m.sum(), n.sum())
        out.append(float((m & n).sum() / least) if least else 0.0)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def box_mask(height: pd.Series, width: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """The mask of a box, truncated to whole pixels and clipped to the image."""
    out = []
    for h, w, a, b, c, d in zip(height, width, x1, y1, x2, y2):
        m = np.zeros((int(h), int(w)), bool)
        m[max(0, int(b)) : max(0, int(d)), max(0, int(a)) : max(0, int(c))] = True
        out.append(encoded(m))
    return pd.Series(out)
