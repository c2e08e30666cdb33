"""Connected components by alternating large-star and small-star rounds, each written as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import drop_scratch, materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from (a, b) edges, for nodes that have one; root is the least node that can be reached."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    state = _state(e)
    while state[0]:
        nearer = materialize(_small_star(_large_star(e)).distinct(), "edges")
        drop_scratch(e)
        e, before = nearer, state
        state = _state(e)
        if state == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialize(nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
