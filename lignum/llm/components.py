"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that has an edge ``a, b``.

    Alternates two contractions: each node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows. Edges only shrink towards stars, whose centres are the answer; the number
    of rounds grows with the logarithm of the longest path. Each round is two grouped minima and is
    written to the shared folder, so no lineage grows. A hub's rows are only ever folded to a minimum
    or joined with one row, which Spark splits. Self-loops and repeated edges are harmless; nulls are
    dropped; no edges give no rows.
    """
    e = written(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = lambda: e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    before = state()  # stars stay as they are, so one round tells that they are
    for _ in range(rounds):
        # To the larger neighbours of u: the smallest of u and all its neighbours.
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # To the smaller neighbours of u and to u itself: the smallest of them. All edges point downwards here.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = state()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
