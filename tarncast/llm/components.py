"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarncast.session import durable


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``label`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Self-loops and repeated edges are allowed, null ends are ignored; an empty table gives an empty
    table. Each step is a partial aggregate and one join, cut by a reliable checkpoint; the number of
    steps grows with the logarithm of the longest chain.
    """
    edges = durable(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        edges = durable(small.select("a", F.col("low").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("low").alias("b"))).filter("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == state:
            break
        state = (now["n"], now["s"])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
