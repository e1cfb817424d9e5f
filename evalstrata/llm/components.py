"""Connected components of links, by contraction: every node points to its smallest neighbour, pointers
are followed, and links between the ends remain. Nothing is gathered by node or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_few, kept, sent


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b), the label being one node of its component. Links of
    a node to itself are allowed. Frames whose counted rows are few are broadcast and written in few files."""
    edges = kept(links.select("a", "b").distinct(), "links")
    n = 2 * edges.count()
    labels = kept(in_few(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), n), "labels")
    open_ends, left = edges.filter("a <> b"), n
    while not open_ends.isEmpty():
        both = open_ends.union(open_ends.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up"))
        parent = kept(in_few(parent, left), "parents")
        up = sent(parent.select(F.col("node").alias("n2"), F.col("up").alias("up2")), left)
        parents = kept(in_few(parent.join(up, F.col("up") == F.col("n2")).select("node", F.least("up", "up2").alias("up")), left), "parents")
        of = lambda end: sent(parents.select(F.col("node").alias(end), F.col("up").alias(f"u{end}")), left)  # noqa: E731,B023
        more = kept(in_few(labels.join(of("label"), "label", "left").select("node", F.coalesce("ulabel", "label").alias("label")), n), "labels")
        ends = open_ends.join(of("a"), "a").join(of("b"), "b").filter("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct()
        fewer = kept(in_few(ends, left), "links")
        dropped(parent, parents, labels, edges)
        labels, edges, open_ends = more, fewer, fewer
        left = 2 * edges.count()
    dropped(edges)
    return labels
