"""Exact integer arithmetic for vectors: fixed-point components, dot products and sums.

A component x becomes floor(scale * x), the scale being a power of two. Integers are kept as int64
where every distance of the batch fits, else as Python integers, so no size of component is
rounded. Dot products go through float64 matrix products of limbs: each factor is broken into limbs
of so few bits that no product of limbs, summed over a vector, reaches 2**53, and the products are put
together in integers again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 2**63 - 1
# Bits of a limb of a sum.
SUM_BITS = 30


def finite(vector: Column, size: int | None = None) -> Column:
    """Whether ``vector`` has no null and no non-finite component and, if given, ``size`` ones."""
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if size is not None:
        fine = fine & (F.size(vector) == size)
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def fixed_point(values: np.ndarray, bits: int) -> np.ndarray:
    """floor(2**bits * x) of finite doubles: int64, or Python integers where one is too large."""
    if not values.size or np.abs(values).max() < 2.0 ** (61 - bits):
        return np.floor(values * 2.0**bits).astype(np.int64)
    # From 2**53 on a double is a whole number.
    whole = [int(x) << bits if abs(x) >= 2**53 else int(np.floor(x * 2.0**bits)) for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def peak(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def limb_bits(size: int) -> int:
    """Bits of a limb, so that ``size`` products of limbs stay below 2**53."""
    return (52 - max(1, size).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of integers, lowest first: all in [0, 2**bits) but the last, which has the sign
    and at most that size."""
    out = []
    while peak(values) > 1 << bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact dot products of the rows of two integer matrices."""
    size = left.shape[1]
    bits = limb_bits(size)
    wide = size * peak(left) * peak(right) > LONGEST
    total = np.zeros((len(left), len(right)), object if wide else np.int64)
    for i, x in enumerate(limbs(left, bits)):
        for j, y in enumerate(limbs(right, bits)):
            product = (x @ y.T).astype(np.int64)
            total = total + (product.astype(object) if wide else product) * (1 << bits * (i + j))
    return total


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of integer ``points`` to integer ``entries``."""
    if points.shape[1] * (peak(points) + peak(entries)) ** 2 > LONGEST:
        points, entries = points.astype(object), entries.astype(object)
    own, theirs = (points * points).sum(axis=1), (entries * entries).sum(axis=1)
    return own[:, None] - 2 * dots(points, entries) + theirs[None, :]


def to_long(values: np.ndarray) -> np.ndarray:
    """int64 of integers; what is beyond the largest is that largest."""
    return np.minimum(values, LONGEST).astype(np.int64)


def sum_rows(group: int, members: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rows ``(group, place, limb, amount)`` whose amounts, summed by the first three, give the
    componentwise sum of ``members``; place -1 counts them."""
    yield group, -1, 0, len(members)
    sums = members.sum(axis=0) if len(members) * peak(members) <= LONGEST else members.astype(object).sum(axis=0)
    for place, total in enumerate(sums.tolist()):
        limb = 0
        while not -(1 << SUM_BITS) <= total < 1 << SUM_BITS:
            yield group, place, limb, total & ((1 << SUM_BITS) - 1)
            total, limb = total >> SUM_BITS, limb + 1
        yield group, place, limb, total


SUM_SCHEMA = "entry int, place int, limb int, amount bigint"


def collected_sums(rows: DataFrame) -> dict[int, tuple[int, dict[int, int]]]:
    """Count and sums by place of every group of ``rows`` (see ``sum_rows``). What comes to the
    driver is bounded by groups times components, whatever the number of vectors."""
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in rows.groupBy("entry", "place", "limb").agg(F.sum("amount").alias("amount")).collect():
        count, sums = out.get(r["entry"], (0, {}))
        if r["place"] < 0:
            count = r["amount"]
        else:
            sums[r["place"]] = sums.get(r["place"], 0) + (r["amount"] << SUM_BITS * r["limb"])
        out[r["entry"]] = count, sums
    return out


def moved(entries: np.ndarray, found: dict[int, tuple[int, dict[int, int]]], start: int = 0) -> np.ndarray:
    """``entries`` with those that have members replaced by floor(sum / count); group ``start + e``
    is entry e."""
    rows = []
    for e, entry in enumerate(entries.tolist()):
        count, sums = found.get(start + e, (0, {}))
        rows.append([sums[p] // count for p in range(len(entry))] if count else entry)
    return integers(rows, entries.shape)


def integers(rows: list[list[int]], shape: tuple[int, ...]) -> np.ndarray:
    """Matrix of Python integers, int64 where they all fit."""
    wide = np.array(rows, dtype=object).reshape(shape)
    return wide if peak(wide) >= 2**61 else wide.astype(np.int64)
