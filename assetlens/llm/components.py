"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links -> (node, component): the smallest id reachable, for every
    node with a link but that smallest one itself.

    Each step writes its edges to the shared folder, so lineage stays short;
    a hub with very many neighbours is joined as a skewed key, never gathered.
    Edges never multiply: each step emits at most one per edge and side.
    """
    current = shared_table(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), name)
    while True:
        # Done when every component is a star: no node has two parents, and
        # no parent has one itself.
        parents = current.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        chained = current.join(current.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if parents.unionAll(chained).isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))))
        current = shared_table(small.filter("u > v").distinct(), name)
