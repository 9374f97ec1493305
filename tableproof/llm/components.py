"""Connected components of an edge table, by alternating stars.

Large stars hang every larger neighbour of a node on its smallest neighbour, small stars do so with the
smaller ones; when nothing moves, every component is a star around its smallest node. Rows of a hub are
never gathered: each step is a map-side combined minimum, written so that both sides of the join are dealt anew, and an equi
join whose hot side adaptive execution splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import settled


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``a, b`` with ``a > b``; the result has the same form."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settled(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        hung = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = settled(edges.groupBy("a").agg(F.min("b").alias("m")), "low")
        met = edges.join(low, "a")
        hung = met.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
    return hung.filter(F.col("a") != F.col("b")).distinct()


def _seal(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free digest of the edges."""
    got = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return got["n"], got["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every node of an edge with the smallest node it reaches.

    Loops, repeated and reversed edges change nothing; null ends are ignored. Each round is written to
    the shared folder, so a lost executor costs one round. Rounds grow with the logarithm of the size."""
    x, y = F.col(a), F.col(b)
    now = edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now = settled(now, "edges")
    seal = _seal(now)
    while seal[0]:
        now = settled(_stars(settled(_stars(now, large=True), "edges"), large=False), "edges")
        after = _seal(now)
        if after == seal:
            break
        seal = after
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
