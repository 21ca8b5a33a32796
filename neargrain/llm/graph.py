"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.llm.common import materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): of every node of ``links`` (a, b) the smallest node that it reaches.

    Alternates two steps until nothing changes: each node hands the smallest of its neighbours to
    its larger neighbours, then the smallest of its smaller neighbours to those. Stars come out;
    the number of rounds grows with the logarithm of a component's length. Minima are partial
    aggregates and nodes with very many neighbours are joined, never gathered.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = materialise(pairs, "links")
    for _ in range(rounds):
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        small = materialise(small, "links")
        # Stars: no node is the larger one of two links, and no smaller one is a larger one.
        done = small.join(small.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").isEmpty()
        pairs = small
        if done and small.groupBy("hi").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
