"""Connected components of a graph given by its edges, by labels that shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ranlens.llm.common import superseded, written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) for all nodes of the edges ``x``, ``y``.

    Each round a node takes the least label beside it, then the label of that label, so the paths to the least node
    halve. Rounds end when no label changes; each is written, which keeps the lineage short. A node with many
    edges is combined before it is shuffled, and its join is one that Spark splits. Without edges there are no nodes.
    """
    both = written(
        edges.where("x <> y").select("x", "y").unionByName(edges.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(),
        "edges",
    )
    labels = written(
        both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels"
    )
    held = labels
    while True:
        beside = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("beside"))
        nearer = labels.join(beside, labels["node"] == beside["x"]).select(
            "node", F.col("label").alias("was"), F.least("label", "beside").alias("near")
        )
        of_label = labels.select(F.col("node").alias("near"), F.col("label").alias("next"))
        moved = written(
            nearer.join(of_label, "near", "left").select("node", "was", F.least("near", F.coalesce("next", "near")).alias("label")), "labels"
        )
        superseded(held)
        held, labels = moved, moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            superseded(both)
            return labels
