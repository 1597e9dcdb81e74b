"""Connected components of an edge table, by hooking to the smallest neighbour and pointer jumping.

All of it is joins and minima combined in the tasks, over written tables; no
component is gathered anywhere. Rounds grow with the logarithm of a component's
diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.sources.shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of an edge (a, b); a component is named by its smallest node. Nodes may be structs."""
    arcs = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "arcs")
    labels = written(arcs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = arcs.join(labels, arcs["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hooks = labels.join(near, labels["node"] == near["a"]).groupBy("component").agg(F.min("near").alias("near"))
        parent = written(hooks.select(F.col("component").alias("old"), F.least("component", "near").alias("new")), "hooks")
        if parent.filter("old <> new").isEmpty():
            return labels
        up = parent.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        jumped = parent.join(up, "new", "left").select("old", F.coalesce("newer", "new").alias("new"))
        labels = written(labels.join(jumped, labels["component"] == jumped["old"], "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
