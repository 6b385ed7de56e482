"""Connected components of a graph of links, over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquilt.llm.common import scratch, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is the smallest id.

    Large-star and small-star steps in turn: each node's greater neighbours, then its
    smaller ones, are linked to the least node of its neighbourhood. Stars shrink a
    path by half a round and need no list of neighbours in one task: the least
    neighbour is an aggregate, and it comes back by a join that Spark can split."""
    with scratch(links.sparkSession) as keep:
        edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        before = None
        for _ in range(most_rounds):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select("v", "u", "m")
            edges = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
            state = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
            if state == before:
                break
            before = state
        else:
            raise RuntimeError("the components did not settle")
        member = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        return keep(member.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component")))
