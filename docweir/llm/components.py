"""Connected components by alternating large-star and small-star steps; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import forget, staged


def _large(e: DataFrame) -> DataFrame:
    """Each node hands the smallest of its neighbours and itself to its larger neighbours."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its smaller neighbours and itself. e has a < b."""
    least = e.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
    j = e.join(least, F.col("b") == F.col("u"))
    return j.select(F.col("m").alias("a"), F.col("a").alias("b")).union(j.select("m", "b")).where("a < b").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether e is a forest of stars: each node is a root or hangs on one."""
    roles = e.select(F.col("a").alias("node"), F.lit(1).alias("root"), F.lit(0).alias("hangs")).union(e.select("b", F.lit(0), F.lit(1)))
    each = roles.groupBy("node").agg(F.max("root").alias("root"), F.sum("hangs").alias("hangs"))
    return each.where("hangs > 1 or root = 1 and hangs > 0").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the component's smallest node.

    Self-loops and repeated edges are allowed; nulls are not. An empty input gives an empty result. Each round is
    written to the shared folder; ends when the edges are stars, whose roots are their smallest nodes.
    """
    e = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    for _ in range(rounds):
        if _settled(e):
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        e = staged(_small(_large(e)), "edges")
        forget(edges.sparkSession)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
