"""Connected components of an undirected graph by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.staging import staged


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node, component`` for every end of ``edges`` (columns ``src, dst``); a component is named by its least node.

    Each round takes over the least label among the neighbours (a partial aggregate, so a node with very many
    neighbours costs no task more than its share) and then jumps to the label's own label, which halves the
    distance to the root; rounds are about the logarithm of the longest path. Labels are written after each round.
    Edges with a null end are ignored; loops make single nodes. No join is broadcast, as labels grow with the nodes
    and each round's would stay in the driver's memory.
    """
    e = edges.where("src is not null and dst is not null").select("src", "dst")
    both = staged(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "cc-edges")
    labels = staged(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("component")).withColumnRenamed("src", "node"), "cc-labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "dst").hint("merge"), "dst")
            .groupBy("src")
            .agg(F.min("component").alias("near"))
            .withColumnRenamed("src", "node")
        )
        seen = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("hop"))
        jump = labels.select(F.col("node").alias("hop"), F.col("component").alias("beyond"))
        labels = staged(
            seen.join(jump.hint("merge"), "hop").select("node", F.least("hop", "beyond").alias("component"), (F.col("old") != F.least("hop", "beyond")).alias("moved")),
            "cc-labels",
        )
        moved = not labels.where("moved").isEmpty()
        labels = labels.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
