"""Connected components by label propagation over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable, for every node with an edge.

    Alternates hooking each node to the smallest label around it with pointer
    jumping, so rounds grow with the logarithm of a chain's length.  Every
    round is a written table in the shared folder; nothing but one count is
    read by the driver.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), f"{name}-0")
    step = 0
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(around.withColumnRenamed("a", "node"), "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        # a root takes the smallest label that any of its members sees; then everyone jumps to the root's label
        roots = hooked.groupBy("component").agg(F.min("low").alias("root"))
        step += 1
        hooked = scratch.save(hooked.join(roots, "component").select("node", F.col("component").alias("old"), F.least("low", "root").alias("component")), f"{name}-h{step}")
        jump = hooked.select(F.col("node").alias("at"), F.col("component").alias("to"))
        new = scratch.save(hooked.join(jump, hooked["component"] == jump["at"], "left").select("node", "old", F.coalesce("to", "component").alias("component")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-h{step}")
        labels = new.select("node", "component")
        if new.filter("old != component").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels
