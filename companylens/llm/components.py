"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companylens.operators.distributed import materialize

ROUNDS = 60


def _summary(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node with a link; the component is its smallest node.

    ``links`` has columns a and b, in any order, with repeats; links with a null end or
    equal ends are ignored. Large-star and small-star steps hang nodes on ever smaller
    neighbours until all hang on the smallest one; the number of rounds grows with the
    logarithm of a component's size. Each round is stored. Minima are partial sums, so a
    node with very many links is never in one task.
    """
    edges = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = materialize(edges, "links")
    before = _summary(edges)
    for _ in range(ROUNDS):
        # Large star: every larger neighbour of a node hangs on its smallest neighbour.
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("least")
        )
        large = (
            both.join(least, F.col("a") == F.col("node"))
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        moved = large.join(least, F.col("a") == F.col("node"))
        small = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
        edges = materialize(small.where(F.col("a") != F.col("b")).distinct(), "links")
        after = _summary(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
