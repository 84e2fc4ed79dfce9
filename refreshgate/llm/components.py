"""Connected components of an edge table, by alternating large-star and small-star steps."""
from pyspark.sql import DataFrame, functions as F

from refreshgate.session import cut_lineage


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b: long); root is the smallest node that it reaches.

    Edges may repeat or be loops. Every step replaces a node's edges by edges to the smallest node that it sees, so a
    node never gets more rows than it had edges; minima are taken before the shuffle. A step ends in a written table.
    The number of steps grows with the logarithm of the longest chain.
    """
    pairs = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        large = cut_lineage(large)
        small = large.join(_lowest(large), "u").select("u", "v", "low")
        pairs = cut_lineage(small.select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))))
            .alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
