"""Connected components of a link table as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import cut


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has a link; root is the smallest
    node of its component.

    Alternating large-star / small-star rounds: every round hangs the larger
    neighbours of a node, then the smaller ones, below the smallest node it
    knows; rounds grow with the logarithm of the component size.  Only
    aggregations with map-side combine and equi-joins, no node's neighbour list
    is ever collected, and each round is a reliable checkpoint.
    """
    x, y = F.col(a), F.col(b)
    e = cut(links.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    state = _state(e)
    while state[0]:
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (sym.filter("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e, before = cut(small), state
        state = _state(e)
        if state == before:
            break
    return (e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
