"""Connected components of a table of edges, by label propagation over reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any orderable type to ``(node, root)``: root is the least node reachable.

    Large-star and small-star steps alternate until nothing changes; each keeps
    the components and leaves a star around each least node in a number of
    rounds that is logarithmic in practice.  Only the number of changed edges
    reaches the driver.  Self loops are ignored; an empty table gives none.
    """
    pairs = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: link every larger neighbour to the least of the node and its neighbours
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: link the node and its smaller neighbours to the least of those
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        after = joined.select("a", F.col("m").alias("b")).union(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = checkpoint(after)
        if after.count() == pairs.count() and after.exceptAll(pairs).isEmpty():
            break
        pairs = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
