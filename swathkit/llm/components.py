"""Connected components of an edge table, by repeated minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.llm.shared import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable), for every node of edges (a, b), any order, no nulls.

    Each round links every node to the least label in its neighbourhood, then follows labels twice,
    so a round more than halves the distance to the root. Every round is written to the shared
    folder; minima combine before the shuffle, so a hub costs one row per task.
    """
    both = edges.select("a", "b").filter("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        # The root of a node learns of smaller labels as well, else long chains would move by one link a round.
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        hooks = step.filter("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        step = materialize(step.join(hooks, "node", "left").select("node", "label", F.least("low", "hook").alias("low")), "step")
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("root"))
        now = step.join(jump, "low", "left").select("node", F.col("label").alias("was"), F.least("low", "root").alias("label"))
        now = materialize(now, "labels")
        labels = now.select("node", "label")
        if now.filter("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
