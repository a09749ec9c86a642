"""Connected components of an edge table, by alternating star contraction in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, unwritten, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(a, b)``.

    Each round links larger neighbours to the smallest one (large star), then smaller
    ones likewise (small star), and writes the result to cut the lineage. Only counts
    reach the driver. Self loops and repeated edges are harmless; nodes are longs.
    Raises ``RuntimeError`` if the rounds do not suffice (they are logarithmic).
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds if state[0] else 0):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = dealt_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now a > b in every row: link each a's smaller neighbours, and a, to its smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = dealt_join(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, written(small, "edges")
        unwritten(before)
        state = _state(now)
        if state[1] == 0 and state[0] == state[2]:  # stars: one centre for each leaf, no centre a leaf
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Edges, leaves that are also centres, distinct leaves."""
    counts = edges.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("leaves")).first()
    chained = dealt_join(edges.select("b").distinct(), edges.select(F.col("a").alias("b")), "b", "left_semi").count()
    return int(counts["n"]), chained, int(counts["leaves"])
