"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node reachable.

    Least labels spread to neighbours and jump to the label of their label, so
    the rounds grow with the logarithm of a path. Each round is written to the
    shared folder; the driver sees one count.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = lower.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), (F.least("mid", F.coalesce("far", "mid")) < F.col("was")).alias("moved"))
        step = materialize(step, "labels")
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            return labels
