"""Connected components of a link table, by union-find inside tasks and contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.session import stored


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one batch: each of its nodes with the least node it reaches."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(root, x) for x in parent if (root := find(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"]
        )


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links (a bigint, b bigint)``; the component is its
    least node.

    Every round maps each node to the first of its closed neighbourhood by number in the
    first two rounds, then in an order that is new in each, and goes on with the links between the chosen nodes. So the
    number of rounds is logarithmic whatever the shape, and a round is one map-side combined
    aggregation and two joins, all of it on disk between rounds.
    """
    at_hand = stored(links.where("a <> b").select("a", "b").mapInArrow(_unite, "a bigint, b bigint").distinct())
    maps: list[DataFrame] = []
    while not at_hand.isEmpty():
        ends = at_hand.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            at_hand.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        order = (lambda c: F.col(c)) if len(maps) < 2 else (lambda c: F.xxhash64(c, F.lit(len(maps))))
        first = F.min(F.struct(order("other").alias("o"), F.col("other").alias("x")))
        own = F.struct(order("node").alias("o"), F.col("node").alias("x"))
        chosen = stored(
            ends.groupBy("node").agg(first.alias("_first")).select("node", F.least("_first", own)["x"].alias("up"))
        )
        maps.append(chosen)
        a = chosen.select(F.col("node").alias("a"), F.col("up").alias("_a"))
        b = chosen.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        moved = at_hand.join(a, "a").join(b, "b").where("_a <> _b")
        moved = moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        at_hand = stored(moved.mapInArrow(_unite, "a bigint, b bigint").distinct())
    if not maps:
        return at_hand.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps[-1]
    for chosen in reversed(maps[:-1]):
        later = labels.select(F.col("node").alias("up"), F.col("up").alias("_top"))
        labels = stored(
            chosen.join(later, "up", "left").select("node", F.coalesce("_top", "up").alias("up"))
        )
    if len(maps) == 1:
        return labels.select("node", F.col("up").alias("component"))
    least = stored(labels.groupBy("up").agg(F.min("node").alias("component")))
    return stored(labels.join(least, "up").select("node", "component"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (node, component)`` with further ``links (a, b)`` taken in.

    Only the components that the links touch are joined anew; of the nodes at rest each is
    read once. Nodes without a label are their own component.
    """
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("_a"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("_b"))
    ends = links.join(a, "a", "left").join(b, "b", "left")
    moved = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = moved.select(F.col("node").alias("_from"), F.col("component").alias("_to"))
    both = labels.join(moved, labels["component"] == moved["_from"], "full")
    return stored(both.select(F.coalesce("node", "_from").alias("node"), F.coalesce("_to", "component").alias("component")))
