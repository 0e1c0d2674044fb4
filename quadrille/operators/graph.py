"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written as cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (only larger ones go, or only smaller ones) are tied to the least of them.
    The least neighbour is a partial aggregate joined back, so that no node's neighbours need fit in a task."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), of any orderable type -> node, root: every node of an edge with the least node that it is connected to.

    Each round is written to the shared folder; rounds end when the edges stay the same, which takes about as many as the
    logarithm of the longest path.  Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = mark(edges)
    while last[0]:
        edges = cut(_stars(_stars(edges, True), False), "stars")
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
