"""Connected components of a graph given as a table of edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a, b; longs): label is one node of the component.

    In each round every node joins the neighbour (or itself) that comes first under a hash
    of that round, then neighbours of neighbours (pointer jumping), and edges are drawn
    between what is left. Under random orders a constant share of the nodes goes each
    round, whatever the shape of the graph. All steps are map-side combined aggregations
    and joins that AQE can split; the driver sees one count a round.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    turn = 0
    while edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        step = settle(both.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a"))).alias("m")).select("a", F.col("m.v").alias("m")), "step")
        onward = step.select(F.col("a").alias("m"), F.col("m").alias("n"))
        step = settle(step.join(onward, "m").select("a", F.col("n").alias("m")), "step")
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("m").alias("label"))
        else:
            onward = step.select(F.col("a").alias("label"), F.col("m").alias("next"))
            labels = labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = settle(labels, "labels")
        ends = [step.select(F.col("a").alias(c), F.col("m").alias(f"{c}2")) for c in ("a", "b")]
        edges = edges.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2")
        edges = settle(edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
