"""Connected components of a graph given as an edge DataFrame.

Min-label propagation with hooking and pointer jumping: whoever holds a label
tells it the smallest one heard, then labels take over their labels' labels.
The rounds are not capped; they end when no label moves. Every round is written to the shared folder,
so nothing depends on executor-local state, and only a count returns to the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node id reachable from node.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type. Nulls and
    self loops are ignored; an empty edge table gives an empty result.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
                         .select("node", "label", F.lit(True).alias("moved")), "cc-labels")
    while True:
        heard = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                 .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard")))
        told = materialize(labels.select("node", "label").join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("best")), "cc-told")
        # Hooking: the label held takes over the smallest one that any of its holders heard.
        hooked = told.groupBy(F.col("old").alias("node")).agg(F.min("best").alias("hook"))
        near = materialize(told.join(hooked, "node", "left").select("node", F.least("best", "hook").alias("label"), "old"), "cc-near")
        # Pointer jumping: take over the label that one's label now has.
        jumped = (near.join(near.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
                  .select("node", F.least("label", "further").alias("label"), "old")
                  .select("node", "label", (F.col("label") != F.col("old")).alias("moved")))
        new = materialize(jumped, "cc-labels")
        moved = new.where("moved").limit(1).count()
        discard(labels, told, near)
        labels = new
        if not moved:
            break
    discard(both)
    return labels.select("node", "label")
