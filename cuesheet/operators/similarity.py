"""Clusters of vectors by cosine similarity: signature bands, exact checks, components.

A band is the side of several random hyperplanes a vector lies on. Two vectors at angle a agree on one
plane with probability 1 - a / pi, so with enough bands a pair at the threshold shares one with any wanted
probability, and closer pairs more surely. Vectors that share a band are compared exactly. No
group or bucket is collected whole: exact copies are one vector from the start, and buckets are
compared in blocks of ``BLOCK`` vectors. Small buckets share a call of a task. Unit vectors travel in 32 bits;
pairs that these leave open at the threshold are compared again in 64.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.components import components
from cuesheet.session import stored

THRESHOLD = 0.9
# Chance that a pair right at the threshold shares no band.
MISS = 1e-4
# Vectors of a bucket aimed at, and most vectors compared as one block.
BUCKET = 512
BLOCK = 4_096
# Rows of several buckets handed to one call in a task.
CALL_ROWS = 8_192


def band_plan(count: int, threshold: float, miss: float) -> tuple[int, int]:
    """Planes of a band and number of bands. More vectors of a group take longer bands, so buckets stay small."""
    bits = min(32, max(4, math.ceil(math.log2(max(1, count) / BUCKET))))
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    share = agree**bits
    return bits, 1 if share >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-share)))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null and no non-finite component, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    # The largest component first, so that squares neither overflow nor vanish.
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _firsts(near: np.ndarray) -> np.ndarray:
    """First row of the component of each row that ``near`` connects."""
    first = np.full(len(near), -1)
    for row in range(len(near)):
        if first[row] >= 0:
            continue
        first[row], queue = row, [row]
        while queue:
            reached = np.nonzero(near[queue.pop()] & (first < 0))[0]
            first[reached] = row
            queue += reached.tolist()
    return first


def _slack(size: int) -> float:
    """Most by which a cosine of unit vectors rounded to 32 bits may be off."""
    return (size + 8) * 2.0**-23


def _links(found: list[tuple[np.ndarray, np.ndarray, bool]]) -> pa.Table:
    """Links of ``(ids, ids, sure)``."""
    a, b = (np.concatenate([np.empty(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))
    sure = np.repeat([f[2] for f in found], [len(f[0]) for f in found]).astype(bool)
    return pa.table({"a": pa.array(a), "b": pa.array(b), "sure": pa.array(sure)})


def _by_bucket(rows: pa.Table, keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The buckets of two rows and more in ``rows``, each with its vectors as a matrix."""
    order = np.lexsort([rows.column(k).to_numpy() for k in keys])
    rows = rows.take(pa.array(order)).combine_chunks()
    differ = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        values = rows.column(k).to_numpy()
        differ |= values[1:] != values[:-1]
    bounds = np.concatenate([[0], np.nonzero(differ)[0] + 1, [len(order)]])
    column = rows.column("v").combine_chunks()
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    for i in np.nonzero(np.diff(bounds) > 1)[0].tolist():
        start, end = int(bounds[i]), int(bounds[i + 1])
        yield rows.slice(start, end - start), flat[at[start] : at[end]].reshape(end - start, -1)


def similar_clusters(
    points: DataFrame, group: Sequence[str], point: str, vector: str, threshold: float = THRESHOLD, miss: float = MISS
) -> DataFrame:
    """``points`` with ``cluster``: the smallest ``point`` linked to it, itself included.

    Points of a group are linked when the cosine of their vectors is at least ``threshold``.
    ``point`` is a whole number that names a point; a null group is a group. Points without a usable
    vector, and vectors of different lengths, are linked with nothing.
    """
    keyed = points.withColumns({"_g": F.struct(*group), "_v": F.col(vector).cast("array<double>"), "_id": F.col(point).cast("bigint")})
    fine = usable(F.col("_v"))
    vectors = stored(keyed.where(fine).groupBy("_g", "_v").agg(F.min("_id").alias("id")).select(F.col("_g").alias("g"), "id", F.col("_v").alias("v")))
    labels = _labels(vectors, threshold, miss)
    named = vectors.join(labels, "id", "left").select(
        F.col("g").alias("_h"), F.col("v").alias("_w"), F.coalesce("component", "id").alias("_cluster")
    )
    joined = keyed.join(named, (F.col("_g") == F.col("_h")) & (F.col("_v") == F.col("_w")) & fine, "left")
    return joined.select(*points.columns, F.coalesce("_cluster", "_id").alias("cluster"))


def _labels(vectors: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Components ``(id, component)`` of different vectors ``(g, id, v)``."""
    # The functions run in tasks travel inside the plan, so executors need no installed package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # A part is what has one group and one length. It is named by its smallest id.
    parts = vectors.groupBy(F.col("g").alias("_g"), F.size("v").alias("_n")).agg(F.min("id").alias("part"), F.count(F.lit(1)).alias("rows"))
    parts = stored(parts)
    count, largest = parts.agg(F.sum("rows"), F.max("rows")).first()
    bits, bands = band_plan(largest or 0, threshold, miss)
    calls = math.ceil((count or 0) * bands / CALL_ROWS) + 1
    weights = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.nonzero(sizes == size)[0]))
                if size not in planes:
                    planes[size] = np.random.default_rng(size).standard_normal((size, bits * bands))
                unit = _units(part.column("v"), size)
                sides = (unit @ planes[size] >= 0).reshape(-1, bands, bits)
                codes = sides @ weights + (np.arange(bands, dtype=np.int64) << 32)
                ends = np.arange(part.num_rows + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("part"), part.column("id"),
                     pa.ListArray.from_arrays(pa.array(ends * size), pa.array(unit.ravel().astype(np.float32))),
                     pa.ListArray.from_arrays(pa.array(ends * bands), pa.array(codes.ravel()))],
                    ["part", "id", "v", "codes"],
                )

    named = vectors.join(parts, (F.col("g") == F.col("_g")) & (F.size("v") == F.col("_n"))).select("part", "id", "v")
    sketch = stored(named.mapInArrow(sign, "part bigint, id bigint, v array<float>, codes array<bigint>"))
    bucket = ["part", "code"]
    signed = sketch.select("part", "id", "v", F.explode("codes").alias("code"))
    # Buckets of more than a block; there are at most bands * vectors / BLOCK of them. Their first vector
    # is compared with all the others, so most of a bucket of near copies is one star.
    crowded = stored(
        signed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where(F.col("n") > BLOCK)
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    )
    many = F.coalesce("blocks", F.lit(1))
    dealt = signed.join(crowded.select(*bucket, "blocks"), bucket, "left").withColumn("block", F.pmod(F.xxhash64("id"), many))
    hubs = crowded.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hubs = hubs.select(*bucket, F.col("hub").alias("id"), F.col("block").cast("bigint")).join(sketch.select("id", "v"), "id")

    def compare(rows: pa.Table) -> pa.Table:
        found = []
        for bucket_rows, unit in _by_bucket(rows, ["block", "code", "part"]):
            slack = _slack(unit.shape[1])
            cosines = unit @ unit.T
            np.fill_diagonal(cosines, -2)
            some = np.nonzero((cosines >= threshold - slack).any(axis=1))[0]
            if not len(some):
                continue
            ids, cosines = bucket_rows.column("id").to_numpy()[some], cosines[np.ix_(some, some)]
            first = _firsts(cosines >= threshold + slack)
            follows = np.nonzero(first != np.arange(len(first)))[0]
            i, j = np.nonzero(np.triu((cosines >= threshold - slack) & (first[:, None] != first[None, :])))
            found += [(ids[first[follows]], ids[follows], True), (ids[i], ids[j], False)]
        return _links(found)

    links = "a bigint, b bigint, sure boolean"
    call = F.pmod(F.xxhash64(*bucket, "block"), F.lit(calls)).alias("call")
    within = dealt.select(*bucket, "id", "v", "block").unionByName(hubs).select("*", call).groupBy("call").applyInArrow(compare, links)
    labels = stored(components(_settled(stored(within), vectors, threshold)))

    # Crowded buckets that are still of several components: whoever is not in the largest one is
    # compared with all the others.
    if crowded.isEmpty():
        return labels
    of = F.coalesce("component", "id").alias("label")
    members = stored(dealt.where("blocks is not null").join(labels, "id", "left").select(*bucket, "blocks", "id", "v", of))
    shares = members.groupBy(*bucket, "label").count()
    mixed = shares.groupBy(*bucket).agg(
        F.max_by("label", F.struct("count", "label")).alias("largest"),
        F.sum("count").alias("n"), F.max("count").alias("most"),
    ).where("n > most").withColumn("rest", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int"))
    mixed = stored(mixed)
    if mixed.isEmpty():
        return labels
    there = members.join(mixed.select(*bucket, "largest", "rest"), bucket)
    own, block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("rest")), F.pmod(F.xxhash64("id"), F.col("blocks"))
    few = there.where("label <> largest").withColumns({"i": own, "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "few": F.lit(True)})
    all_ = there.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("rest") - 1)), "j": block, "few": F.lit(False)})
    columns = [*bucket, F.col("i").cast("bigint"), F.col("j").cast("bigint"), "few", "id", "v", "label"]

    def across(rows: pa.Table) -> pa.Table:
        found = []
        for bucket_rows, unit in _by_bucket(rows, ["j", "i", "code", "part"]):
            ids, label, few = (bucket_rows.column(c).to_numpy() for c in ("id", "label", "few"))
            here, others = np.nonzero(few)[0], np.nonzero(~few)[0]
            cosines, slack = unit[here] @ unit[others].T, _slack(unit.shape[1])
            near = (cosines >= threshold - slack) & (label[here][:, None] != label[others][None, :])
            for r in np.nonzero(near.any(axis=1))[0].tolist():
                sure = others[near[r] & (cosines[r] >= threshold + slack)]
                _, once = np.unique(label[sure], return_index=True)
                rest = others[near[r] & ~np.isin(label[others], label[sure])]
                for to, is_sure in ((sure[once], True), (rest, False)):
                    found.append((np.full(len(to), ids[here[r]]), ids[to], is_sure))
        return _links(found)

    more = few.select(*columns).unionByName(all_.select(*columns))
    call = F.pmod(F.xxhash64(*bucket, "i", "j"), F.lit(calls)).alias("call")
    more = _settled(stored(more.select("*", call).groupBy("call").applyInArrow(across, links)), vectors, threshold)
    known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return stored(components(known.unionByName(more)))


def _settled(links: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)`` of the sure links, and of those others whose cosine in 64 bits reaches the threshold."""
    sure, doubtful = links.where("sure").select("a", "b"), links.where("not sure").select("a", "b").distinct()
    ends = [vectors.select(F.col("id").alias(c), F.col("v").alias(f"v{c}")) for c in "ab"]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("va").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.nonzero(sizes == size)[0]))
                cosines = (_units(part.column("va"), size) * _units(part.column("vb"), size)).sum(axis=1)
                yield part.filter(pa.array(cosines >= threshold)).select(["a", "b"])

    there = doubtful.join(ends[0], "a").join(ends[1], "b").select("a", "b", "va", "vb")
    return sure.unionByName(there.mapInArrow(exact, "a bigint, b bigint"))
