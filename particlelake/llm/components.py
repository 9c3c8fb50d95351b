"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from particlelake.llm.common import stored


def _largest_to_smallest(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _largest_to_smallest(
        both.where("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to the smallest of them."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _largest_to_smallest(moved.unionByName(smallest.select("a", F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
        ).first()
    )


def linked_components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of ``links(a, b)``; root is the smallest id it reaches.

    A node with very many links never meets them in one task: its smallest
    neighbour comes from a partial aggregate, and the joins are ones whose large
    keys Spark splits. Rounds grow with the logarithm of the longest path; each is
    written to the shared folder. Nulls are no nodes; an empty table gives one.
    """
    edges = stored(_largest_to_smallest(links.where("a is not null and b is not null")), "links")
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
