"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int | None = None) -> DataFrame:
    """node, label (smallest node reached) for every node of an edge (columns a, b).

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label; a path shrinks to half or less. Rounds are written
    to the shared folder. With ``rounds`` it may stop early: labels then are of
    the same component, but a component may have several.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.keep(both, f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while rounds is None or step < rounds:
        step += 1
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("best"))
        up = labels.select(F.col("node").alias("top"), F.col("label").alias("top_label"))
        new = best.join(up, best.best == up.top).select("node", F.least("best", "top_label").alias("label"), (F.least("best", "top_label") < F.col("label")).alias("moved"))
        new = scratch.keep(new, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            break
    return labels
