"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope.llm.common import discard, staged


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(
        "u <> v").distinct()


def _chained(e: DataFrame) -> bool:
    """Whether some node has both a smaller and a larger neighbour, or several
    smaller ones: then the edges are not yet stars around least nodes."""
    if not e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
        return True
    return not e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: component is the least node it
    is connected with. Each round is written to the shared folder; the rounds grow
    with the logarithm of the longest path. Minima are pre-aggregated, and the
    joins back to a node's edges may be split where a node has very many."""
    e = staged(_ordered(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    before = None
    while True:
        # large star: every neighbour above u is tied to the least of u's neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"),
                                                       F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("a"), F.least("u", "m").alias("b")))
        # small star: u and its lower neighbours are tied to the least of them
        low = _ordered(large)
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        last, e = e, staged(_ordered(small.unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))), "edges")
        discard(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                    .alias("s")).first()
        if now == before or not _chained(e):
            break
        before = now
    tied = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tied.unionByName(roots)
