"""Vector code compression: product codes learned and assigned in exact integer arithmetic.

Components become integers floor(4096 * x); a vector is cut into ``PARTS`` consecutive parts, and each
part is replaced by the number of the nearest of ``ENTRIES`` codebook entries of its place. Nearest
is decided on exact squared distances, from limb-split matrix products (``integers``), ties by the lower
number (the first minimum), so codes do not depend on how rows are dealt to tasks. Codebooks start as
parts of the rows with the smallest ids and are moved ``ROUNDS`` times to the floored means of what they
were nearest to. A round is one pass in which each task sends the sums of its members; the
sums by entry, bounded by the size of the codebooks, come to the driver.

Defined results: rows without a vector, or with a null or non-finite component, are dropped, as are
rows whose vector is empty or not as long as the commonest (of equally common lengths the shortest).
Where the parts do not divide a vector evenly the first ones are one longer; parts beyond the
components are empty, at distance 0. Rows with equal ids are all coded; for the start they are ordered by
their components, rows without an id come last. Fewer rows than entries give a smaller codebook, an
empty table no rows. Errors past 64 bits are given as the largest long. Extra columns are not carried.
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

SCALE_BITS = 12
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Vectors whose distances are computed at once.
BLOCK = 4_096


@dataclass
class Codebooks:
    """``parts[p]`` holds the integer entries of part p, one a row."""

    parts: list[np.ndarray]
    scale_bits: int


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """Rows that take part, their vectors as ``v array<double>``, and the length of the vectors."""
    v = F.col(column).cast("array<double>")
    good = vectors.withColumn("v", v).where(integers.finite(F.col("v")) & (F.size("v") > 0))
    commonest = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = commonest["size"] if commonest else 0
    return good.where(F.size("v") == size), size


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """First and end component of each part."""
    ends = np.cumsum([size // parts + (p < size % parts) for p in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def blocks(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in blocks, with the integers of their vectors, which are the last column."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, integers.fixed_point(matrix(part.column(part.num_columns - 1), size), bits)


def learn(
    vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale_bits: int = SCALE_BITS
) -> Codebooks:
    """Codebooks of ``vectors (vec_id, v)``, all of ``size`` components."""
    cuts = bounds(size, parts)
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = integers.fixed_point(np.array([r["v"] for r in first], float).reshape(len(first), size), scale_bits)
    books = [start[:, a:b] for a, b in cuts]
    for _ in range(rounds):

        def members(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            for _, points in blocks(batches, size, scale_bits):
                rows = []
                for p, (a, b) in enumerate(cuts):
                    own = points[:, a:b]
                    code = integers.squared_distances(own, books[p]).argmin(axis=1)
                    for e in np.unique(code).tolist():
                        rows += integers.sum_rows(p * entries + e, own[code == e])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                    ["entry", "place", "limb", "amount"],
                )

        found = integers.collected_sums(vectors.select("v").mapInArrow(members, integers.SUM_SCHEMA))
        books = [integers.moved(book, found, p * entries) for p, book in enumerate(books)]
    return Codebooks(books, scale_bits)


def encode(vectors: DataFrame, size: int, codebooks: Codebooks) -> DataFrame:
    """``vec_id``, ``label``, ``code array<int>`` (an entry for each part) and ``error`` (squared
    distance to the entries) of ``vectors (vec_id, label, v)``."""
    cuts, books, bits = bounds(size, len(codebooks.parts)), codebooks.parts, codebooks.scale_bits
    given = vectors.select("vec_id", "label", "v")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points in blocks(batches, size, bits):
            codes, errors = [], 0
            for book, (a, b) in zip(books, cuts):
                d = integers.squared_distances(points[:, a:b], book)
                code = d.argmin(axis=1)
                codes.append(code)
                # Added as Python integers: the parts may fit 64 bits where their sum does not.
                errors = errors + d[np.arange(len(d)), code].astype(object)
            flat = np.stack(codes, axis=1).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), len(books)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), lists, pa.array(integers.to_long(errors))], ["vec_id", "label", "code", "error"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error bigint")


def decode(coded: DataFrame, size: int, codebooks: Codebooks) -> DataFrame:
    """``coded`` with ``approximate array<double>``: the vector its code stands for."""
    scale = 2.0**codebooks.scale_bits
    books = F.array(*[F.array(*[F.lit([int(x) / scale for x in e]).cast("array<double>") for e in b.tolist()]) for b in codebooks.parts])
    return coded.withColumn("approximate", F.flatten(F.zip_with(books, "code", lambda book, c: F.element_at(book, c + 1))))


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over rows of an equal label (nulls together)."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(integers.LONGEST).cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.cast("bigint").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def compress(vectors: DataFrame) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable rows of ``vectors (vec_id, embedding, label)``, with ``label_error``, and the
    codebooks they refer to."""
    good, size = usable(vectors.select("vec_id", "embedding", "label"))
    codebooks = learn(good, size)
    return label_errors(stored(encode(good, size, codebooks))), codebooks
