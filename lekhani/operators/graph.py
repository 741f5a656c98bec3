"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhani.session import cut_lineage


def star_edges(df: DataFrame, node: str, group: str) -> DataFrame:
    """Edges from each node to the smallest of its group: as many as nodes, never all pairs."""
    centre = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(node).alias("dst"))
    return df.join(centre, group).where(F.col(node) != F.col("dst")).select(F.col(node).alias("src"), "dst").distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str, rounds: int = 50) -> DataFrame:
    """``node, component``: the smallest node that each one is connected with.

    A round takes the smallest label of the neighbours and then the label of the label, so long chains
    halve. Labels are written to the checkpoint folder each round. Labels that still move after ``rounds`` are an error.
    """
    both = cut_lineage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut_lineage(nodes.select(F.col(node).alias("n"), F.col(node).alias("label")).distinct())
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["n"]).groupBy("src").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["n"] == near["src"], "left").select("n", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = lower.select(F.col("n").alias("j"), F.col("new").alias("jumped"))
        moved = cut_lineage(lower.join(jump, lower["new"] == jump["j"]).select("n", F.col("label").alias("old"), F.least("new", "jumped").alias("label")))
        changed = moved.where("old <> label").limit(1).count()
        labels = moved.select("n", "label")
        if not changed:
            return labels.select(F.col("n").alias(node), F.col("label").alias("component"))
    raise RuntimeError(f"components aren't finished after {rounds} rounds")
