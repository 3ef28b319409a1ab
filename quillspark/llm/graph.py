"""Connected components of a small-world edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b) with the least node of its
    component. Rounds of least-neighbour labels and pointer jumps, each written
    to the shared folder; a component of diameter d takes about log2(d) rounds.
    No edges give no rows; nulls and self-loops are dropped."""
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("up"))
        new = step.join(jump, step.low == jump.via, "left").select("node", F.least("low", F.coalesce("up", "low")).alias("next"), "root")
        new = materialize(new)
        labels = new.select("node", F.col("next").alias("root"))
        if not new.where("next <> root").limit(1).count():
            return labels
