"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join the neighbours of each node (its larger ones, or the rest and itself) to the smallest."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges ``a, b``.

    Nodes without an edge, and self loops, give no row. Each round writes its edges to the shared
    folder; rounds grow with the logarithm of a component's size. No node's neighbours are gathered.
    """
    edges = materialize(edges.where("a != b").select("a", "b").distinct())
    # Each edge set is the same graph; it is a forest of stars once a round changes nothing.
    mark = None
    for _ in range(rounds):
        before, edges = edges, materialize(_star(_star(edges, True), False))
        discard(before)
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
    raise RuntimeError(f"no fixed point after {rounds} rounds")
