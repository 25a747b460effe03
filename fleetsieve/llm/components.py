"""Connected components of a table of links, for graphs of any size and hot nodes.

Alternating stars: every node links itself to the smallest label it knows of, first among its larger
neighbours and then among its smaller ones, until nothing changes. Each round is two aggregations
with map-side minima and a reliable checkpoint; no node's neighbours meet in a list.
"""
from pyspark.sql import DataFrame, functions as F

from fleetsieve.session import cut


def components(edges: DataFrame, rounds=60) -> DataFrame:
    """edges (a, b) -> (node, root) of every node that a link between two different nodes touches; root
    is the smallest node of its component. Nulls and loops are no links; raises if `rounds` don't do."""
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct())
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("least")).withColumn("least", F.least("node", "least"))
        large = both.filter("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to"))
        large = large.filter("node <> to").distinct()
        lower = large.groupBy("node").agg(F.min("to").alias("least"))
        small = large.join(lower, "node").select(F.when(F.col("to") == F.col("least"), F.col("node")).otherwise(F.col("to")).alias("node"), F.col("least").alias("to"))
        links = cut(small.filter("node <> to").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return links.select("node", F.col("to").alias("root")).unionByName(links.select(F.col("to").alias("node"), F.col("to").alias("root")).distinct())
