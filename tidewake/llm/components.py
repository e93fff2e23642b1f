"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import settled


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for each end of links(a, b); label is the component's smallest node.

    Each round every node takes the least label among itself and its
    neighbours, then the label of that label, so labels halve their distance to
    the root and stars settle in two rounds.  Only minima are gathered, with
    map-side combining, so a node with very many links costs no memory; the
    skewed joins are AQE's to split.  Links to itself, repeated links and an
    empty table are allowed.
    """
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = settled(ends.where("a is not null and b is not null").distinct())
    labels = settled(ends.groupBy("a").agg(F.min(F.least("a", "b")).alias("l")))
    while True:
        near = ends.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("n"))
        best = labels.join(near, "a").select("a", "l", F.least("l", "n").alias("m"))
        jump = labels.select(F.col("a").alias("m"), F.col("l").alias("j"))
        moved = settled(best.join(jump, "m").select("a", F.least("m", "j").alias("l"), (F.least("m", "j") < F.col("l")).alias("changed")))
        labels = moved.select("a", "l")
        if moved.where("changed").limit(1).count() == 0:
            return labels.select(F.col("a").alias("node"), F.col("l").alias("label"))
