"""Connected components over an edge table, in rounds of Spark joins.

Each round links every node to the smallest label among its own and its
neighbours' and then follows labels of labels (pointer jumping), so the number of
rounds grows with the logarithm of a component's diameter. Every round is a table
in the shared folder. Nothing but the number of changed nodes reaches the driver;
a node with very many neighbours is pre-aggregated before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for all nodes in ``edges (a long, b long)``; the label is the
    smallest node of the component. Self-loops and repeated edges are allowed."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "components-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "components-labels")
    while True:
        # smallest label among the neighbours
        seen = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        hooked = (labels.join(seen, labels["node"] == seen["a"], "left")
                  .select("node", "label", F.least("label", "near").alias("low")))
        # the node's old label learns it too, so whole trees move at once
        roots = hooked.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("root_low"))
        hooked = hooked.join(roots, hooked["label"] == roots["root"]).select(
            "node", F.col("label").alias("old"), F.least("low", "root_low").alias("label"))
        # pointer jumping: the label of the label
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        moved = written(hooked.join(up, hooked["label"] == up["up"], "left")
                        .select("node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label")),
                        "components-labels")
        changed = moved.filter("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
