"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tideline.llm.shared import written


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """A written set of edges, and numbers that tell it from other ones, taken as it is written."""
    seen = Observation()
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1000000007).alias("sum"), F.bit_xor(F.xxhash64("v", "u")).alias("bits")]
    table = written(edges.observe(seen, *marks), "edges")
    return table, tuple(seen.get.get(k) for k in ("n", "sum", "bits"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component is its least node. ``edges`` has a and b.

    Every round hangs the larger neighbours of a node under the least one, then a node and its smaller neighbours
    under their least. The rounds end when the edges stay the same, which then all lead to the least node. Only counts
    and digests reach the driver; each round is one written table. Rows are dealt by their larger node, which keeps few
    edges, so that removing repeats, the least neighbour and the join with it share one exchange.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars, before = _stored(stars.repartition("u").distinct())
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).repartition("u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = small.unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v")
        stars, after = _stored(small.repartition("u").distinct())
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
