"""Connected components by alternating large and small stars; every step is joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.runtime import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) undirected links of any orderable type -> (node, component): the least node reachable.

    Nodes without a link do not appear; nulls and self-links are ignored; repeated links count once.
    Both sides of each join are tables of their own, so that adaptive execution can split a hub that
    most links lead to. No link is ever on the driver: it compares two numbers a round.
    """
    star = scratch.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    seen = _digest(star)
    while True:
        # large star: the higher neighbours of a node move to the least node around it
        both = star.union(star.select("lo", "hi")).toDF("node", "other")
        least = scratch.save(both.groupBy("node").agg(F.least("node", F.min("other")).alias("least")), "least")
        large = scratch.save(star.join(least, star.lo == least.node).select("hi", F.col("least").alias("lo")).distinct(), "large")
        # small star: a node and its lower neighbours move to the least of them
        below = scratch.save(large.groupBy("hi").agg(F.min("lo").alias("least")).withColumnRenamed("hi", "node"), "below")
        moved = large.join(below, large.hi == below.node).where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        small = scratch.save(moved.union(below.select("node", "least")).distinct(), "small")
        scratch.drop(star, least, large, below)
        star, before, seen = small, seen, _digest(small)
        if seen == before:
            break
    found = star.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return found.union(found.select("component", "component").distinct())


def _digest(star: DataFrame):
    return star.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
