"""Centroid clustering with bounds that geometry keeps tight.

Every vector carries a lower bound of its distance to all centroids but its own. When centroids
move, that bound must be loosened, at worst by how far the other centroids moved (their full drift). Here it
is loosened by less. The members of a cluster lie in a sphere of radius r about their old centroid c. For
another centroid that moves from p to q by D, with middle m, a vector x comes nearer by

    |x - p| - |x - q| = 2 (q - p)(x - m) / (|x - p| + |x - q|)  <=  D cos(angle of x - m and q - p)

where the right side holds if the cosine is positive, and 0 does if not. Seen from m the sphere
fills a cone of half angle arcsin(r / |c - m|) about c - m, so in the plane of c, p and q the loosening is
D cos(angle of c - m and q - p, less that half angle): nothing for centroids that move away from
the sphere or along its flank, and full drift only for those that move straight at it or from within it.

A vector whose exact distance to its own moved centroid stays below the loosened bound keeps its
cluster; the others are ambiguous and scanned exactly against all centroids. Integers are exact
(``integers``), bounds are floats with a margin, so clusters, ties included, are those of a full scan.

The state is a table written in the shared folder each round: vector, cluster and bound. A round is
one pass over it; sums, counts and radii by cluster, bounded by the number of centroids, come to the
driver.

Defined results: rows whose vector is null, is not ``size`` long or holds a null or non-finite component
are dropped. Rows with equal ids are all clustered; as starting points they are ordered by their
components, rows without an id come last. Fewer rows than ``clusters`` give fewer clusters, an empty
table no rows. Distances past 64 bits are given as the largest long. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm import integers
from cuesheet.session import stored

SIZE = 64
CLUSTERS = 16
ROUNDS = 3
SCALE_BITS = 6
BLOCK = 4_096
# Share of error allowed to bounds, which are floats; distances are exact.
MARGIN = 1e-6


@dataclass
class Clustering:
    """``vectors``: vec_id, cluster, distance (squared); ``centroids``: integers, a row each;
    ``inertias``: sum of distances by cluster; ``scanned``: vectors scanned against all centroids in
    each assignment."""

    vectors: DataFrame
    centroids: np.ndarray
    inertias: list[int]
    scanned: list[int]


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer any other centroid can have come to a vector of it."""
    count = len(old)
    out = np.zeros(count)
    for j in range(count):
        step = (new[j] - old[j]).astype(float)
        drift = float(np.sqrt(step @ step))
        if drift == 0:
            continue
        # Twice c - m, exact before it becomes a float.
        from_middle = (2 * old - old[j] - new[j]).astype(float)
        far = np.sqrt((from_middle * from_middle).sum(axis=1))
        outside = far > 2 * radii * (1 + MARGIN)
        near = np.where(outside, far, 1.0)
        cosine = np.clip(from_middle @ step / (near * drift), -1, 1)
        half = np.where(outside, np.minimum(2 * radii / near, 1), 1)
        sine = np.sqrt(np.maximum(1 - cosine * cosine, 0))
        within = cosine >= np.sqrt(1 - half * half)  # the axis runs through the sphere's cone
        best = np.where(outside & ~within, cosine * np.sqrt(1 - half * half) + sine * half, 1.0)
        loss = drift * np.clip(best + MARGIN, 0, 1 + MARGIN)
        loss[j] = 0
        out = np.maximum(out, loss)
    return out


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def assigned(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, exact squared distance and bound of the other distances, by a full scan."""
    d = integers.squared_distances(points, centroids)
    cluster = d.argmin(axis=1)
    at = np.arange(len(d))
    own = d[at, cluster]
    if d.shape[1] == 1:
        return cluster, own, np.full(len(d), np.inf)
    others = _roots(d)
    others[at, cluster] = np.inf
    return cluster, own, others.min(axis=1)


def reassigned(
    points: np.ndarray, cluster: np.ndarray, bound: np.ndarray, centroids: np.ndarray, loose: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after a move, scanning only ambiguous vectors; how many those were comes last."""
    own = np.zeros(len(points), object)
    for c in np.unique(cluster).tolist():
        mine = cluster == c
        own[mine] = integers.squared_distances(points[mine], centroids[c : c + 1])[:, 0]
    bound = bound - loose[cluster]
    ambiguous = ~(_roots(own) * (1 + MARGIN) < bound)
    cluster = cluster.copy()
    if ambiguous.any():
        cluster[ambiguous], own[ambiguous], bound[ambiguous] = assigned(points[ambiguous], centroids)
    return cluster, own, bound, int(ambiguous.sum())


def _seeds(good: DataFrame, clusters: int, scale_bits: int, salt: str) -> np.ndarray:
    """The vectors of the smallest hashes of ``<salt>:<vec_id>``."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = good.orderBy(key.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    values = np.array([r["v"] for r in first], float)
    return integers.fixed_point(values.reshape(len(first), -1 if len(first) else 0), scale_bits)


def cluster(
    vectors: DataFrame, size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale_bits: int = SCALE_BITS, salt: str = "1"
) -> Clustering:
    """Clusters of ``vectors (vec_id, embedding)`` after ``rounds`` moves of the centroids."""
    wide = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    v = F.col("embedding").cast("array<double>") if wide else F.col("embedding")
    given = vectors.select("vec_id", v.alias("v"))
    good = given.where(integers.finite(F.col("v"), size))
    kind, vector = (f.dataType.simpleString() for f in given.schema)
    centroids = _seeds(good, clusters, scale_bits, salt)
    schema = f"vec_id {kind}, v {vector}, cluster int, distance decimal(38,0), bound double, scanned int"

    def result(part: pa.RecordBatch, cluster, own, bound, scanned: int) -> pa.RecordBatch:
        exact = pa.array([min(int(d), 10**38 - 1) for d in own.tolist()], pa.decimal128(38, 0))
        counts = np.zeros(len(own), np.int32)
        counts[:1] = scanned
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(cluster, pa.int32()), exact, pa.array(bound, pa.float64()), pa.array(counts)],
            ["vec_id", "v", "cluster", "distance", "bound", "scanned"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                values = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield part, integers.fixed_point(values.reshape(part.num_rows, size), scale_bits)

    def first(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
        for part, points in blocks(batches):
            yield result(part, *assigned(points, centroids), part.num_rows)

    state = stored(good.mapInArrow(first, schema))
    scanned = []
    for _ in range(rounds):

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, points in blocks(batches):
                of = part.column(0).to_numpy()
                rows = [r for c in np.unique(of).tolist() for r in integers.sum_rows(c, points[of == c])]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["entry", "place", "limb", "amount"])

        known = _summary(state)
        scanned.append(sum(r["scanned"] for r in known.values()))
        found = integers.collected_sums(state.select("cluster", "v").mapInArrow(members, integers.SUM_SCHEMA))
        after = integers.moved(centroids, found)
        radii = np.array([float(known[c]["far"]) ** 0.5 if c in known else 0.0 for c in range(len(centroids))])
        loose = loosening(centroids, after, radii)
        centroids = after

        def again(batches: Iterator[pa.RecordBatch], centroids=centroids, loose=loose) -> Iterator[pa.RecordBatch]:
            for part, points in blocks(batches):
                of, bound = part.column(2).to_numpy(), part.column(3).to_numpy()
                yield result(part, *reassigned(points, of, bound, centroids, loose))

        state = stored(state.select("vec_id", "v", "cluster", "bound").mapInArrow(again, schema))
    known = _summary(state)
    scanned.append(sum(r["scanned"] for r in known.values()))
    distance = F.least("distance", F.lit(integers.LONGEST).cast("decimal(38,0)")).cast("bigint")
    return Clustering(
        state.select("vec_id", "cluster", distance.alias("distance")),
        centroids,
        [int(known[c]["inertia"]) if c in known else 0 for c in range(len(centroids))],
        scanned,
    )


def _summary(state: DataFrame) -> dict[int, dict]:
    """Largest and summed squared distance and vectors scanned, by cluster: a row for each centroid."""
    sums = state.groupBy("cluster").agg(
        F.max("distance").alias("far"), F.sum("distance").alias("inertia"), F.sum("scanned").alias("scanned")
    )
    return {r["cluster"]: r.asDict() for r in sums.collect()}
