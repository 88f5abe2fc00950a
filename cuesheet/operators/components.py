"""Connected components of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.session import stored


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``links (a, b)``; a component is named by its smallest id.

    Two steps alternate until nothing changes: every node hands its smallest neighbour to its
    larger ones, then to its smaller ones and itself. The number of rounds grows with the logarithm
    of the links, not with the length of a chain. A hub is one key with many rows, so its minimum is an
    aggregate (combined map-side) joined back, which adaptive execution may split, never a window.
    """
    # Each link runs from its larger end to its smaller one.
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        spread = _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _with_smallest(spread)
        edges = stored(
            least.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _with_smallest(edges: DataFrame) -> DataFrame:
    """``edges`` with ``m``, the smallest of ``u`` and its neighbours."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("_m"))
    return edges.join(smallest, "u").select("u", "v", F.least("u", "_m").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    """Equal marks of two sets of edges mean that they are the same."""
    folded = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), folded, F.sum(F.col("v").cast("decimal(38,0)"))).first())
