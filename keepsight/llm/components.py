"""Connected components of an edge table, by hooking and pointer jumping.

Each round hooks every component to the smallest label next to it and then
shortens the chains of labels. All of it is joins and pre-aggregated minima
over written tables; no component is ever gathered in one place, and a label
shared by very many nodes meets its new label in a join of two plain
exchanges, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.tables import Table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of an edge (a, b): label is the smallest node reachable. Self-loops are allowed."""
    both = Table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "arcs")
    labels = Table(both.read().select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        arcs, now = both.read(), labels.read()
        near = arcs.join(now, arcs["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooks = now.join(near, now["node"] == near["a"]).groupBy("label").agg(F.min("near").alias("near"))
        parent = Table(hooks.select(F.col("label").alias("old"), F.least("label", "near").alias("new")), "parents")
        p, q = parent.read().alias("p"), parent.read().alias("q")
        if p.filter("old <> new").isEmpty():
            parent.drop()
            return now
        jump = Table(p.join(q, F.col("p.new") == F.col("q.old")).select(F.col("p.old").alias("old"), F.col("q.new").alias("new")), "jumps")
        j = jump.read()
        after = Table(now.join(j, now["label"] == j["old"]).select("node", F.col("new").alias("label")), "labels")
        for t in (labels, parent, jump):
            t.drop()
        labels = after
