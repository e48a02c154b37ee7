"""Connected components of a link table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, remove, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node that links reach.

    Each round every node takes the least label among itself and its neighbours,
    then the label of its label; rounds end when nothing changes.  Labels are
    written to the shared folder each round, so lineage stays short, and replace those before.  Self-links
    and repeated links are allowed; no links give no rows.
    """
    both = links.select(F.col(a).alias("_x"), F.col(b).alias("_y")).union(links.select(F.col(b).alias("_x"), F.col(a).alias("_y")))
    edges = materialize(both.distinct(), "edges")
    labels, path = written(edges.groupBy("_x").agg(F.least(F.first("_x"), F.min("_y")).alias("_l")), "labels")
    while True:
        near = edges.join(labels.select(F.col("_x").alias("_y"), "_l"), "_y").groupBy("_x").agg(F.min("_l").alias("_m"))
        step = labels.join(near, "_x").select("_x", F.col("_l").alias("_was"), F.least("_l", "_m").alias("_l"))
        jump = labels.select(F.col("_x").alias("_l"), F.col("_l").alias("_up"))
        moved, newer = written(step.join(jump, "_l").select("_x", "_was", F.least("_l", "_up").alias("_l")), "labels")
        remove(edges.sparkSession, path)
        labels, path = moved.select("_x", "_l"), newer
        if moved.where(F.col("_l") != F.col("_was")).isEmpty():
            return labels.select(F.col("_x").alias("node"), F.col("_l").alias("component"))
