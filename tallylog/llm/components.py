"""Connected components by rounds of contraction: nodes take the least of their neighbours, and edges within what has become one node are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node on an edge, and the least node of its component.

    Each round aggregates the least label among a node's neighbours before any exchange, follows labels to their ends (each step doubles their reach), and draws the edges between these ends. What lies
    within one node then is dropped, so most edges meet labels once, not in every round. A node that neither takes a label nor gives one has a neighbour that took a lesser one, and takes one in the next round: at least half
    of the nodes go every two rounds. Tables are written each round; nothing but a count gets to the driver.
    """
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    left = stage_table(edges.select(*pair(a, b)).where("a != b").distinct(), "edges")
    whole = None
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        labels = stage_table(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
        moved = True
        while moved:
            hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
            new = stage_table(labels.join(hop, "label").select("node", F.col("hop").alias("new"), F.col("label").alias("old")), "labels")
            moved = new.where("new != old").limit(1).count()
            labels = new.select("node", F.col("new").alias("label"))
        end = lambda name, to: labels.select(F.col("node").alias(name), F.col("label").alias(to))  # noqa: B023, E731
        whole = labels if whole is None else stage_table(whole.join(end("label", "end"), "label", "left").select("node", F.coalesce("end", "label").alias("label")), "ends")
        left = stage_table(left.join(end("a", "x"), "a").join(end("b", "y"), "b").select(*pair("x", "y")).where("a != b").distinct(), "edges")
        if not left.limit(1).count():
            return whole.withColumnRenamed("label", "component")
