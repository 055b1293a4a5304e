"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node reachable.

    Alternating large-star and small-star steps: each step groups by one node
    and points neighbours at the smallest one, until nothing changes. A step
    keeps at most one row per node and link, so a hub costs as many rows as it
    has links. Every step is written to the checkpoint folder.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(edges)
    before = _digest(edges)
    while True:
        both = _both_ways(edges, "a", "b")
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        after = materialise(large.join(least, "a").select(small.alias("x")).select("x.a", "x.b").where("a <> b").distinct())
        now = _digest(after)
        if now == before:
            break
        edges, before = after, now
    stars = after.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return materialise(stars.union(roots.join(stars, "node", "left_anti")))


def _both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each link and its reverse; a union would plan and read everything below it twice."""
    ways = F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b"))))
    return edges.select(ways.alias("x")).select("x.a", "x.b")


def _digest(df: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b")
    return tuple(df.agg(F.count("*"), F.bit_xor(mark), F.sum((mark % 1000003).cast("decimal(38,0)"))).first())
