"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.llm.common import forget, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a long, b long); component is the smallest node.

    Alternating large-star and small-star steps: every step hangs the neighbours of a node on
    the smallest of them, so that a component becomes a star in about log(n) rounds, and no step
    holds the neighbours of one node in one task. Each round's edges are written to the shared
    folder. Loops and repeated edges do no harm; nodes with none but loops give themselves; an
    empty list gives none.
    """
    current = written(_tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    mark = _mark(current)
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    for _ in range(most_rounds):
        if not mark[0]:
            break
        large = _large_star(current)
        following = written(_tidy(_small_star(large)), "edges")
        forget(current)
        current, before, mark = following, mark, _mark(following)
        if before == mark:
            break
    else:
        raise RuntimeError(f"no fixed point within {most_rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = loops.distinct().join(stars.select("node").union(roots.select("node")), "node", "left_anti")
    return stars.union(roots).union(alone.withColumn("component", F.col("node")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them."""
    edges = edges.where("a > b")
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
    hung = edges.join(least, F.col("a") == F.col("c"))
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
