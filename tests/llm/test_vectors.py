"""Exact vector operators against plain Python integers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from cuesheet.llm import centroids, integers, vector_codes

VECTOR = "vec_id long, label int, embedding array<double>"


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, entries):
    return min(range(len(entries)), key=lambda e: (distance(v, entries[e]), e))


def means(points, of, entries):
    out = list(entries)
    for e in range(len(entries)):
        mine = [p for p, c in zip(points, of) if c == e]
        if mine:
            out[e] = [sum(x) // len(mine) for x in zip(*mine)]
    return out


def fixed(v, scale):
    return [math.floor(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks of rows with usable vectors of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(rows[0][2])
    cuts = vector_codes.bounds(size, parts)
    points = [fixed(v, 4096) for _, _, v in rows]
    code, error, books = [[] for _ in rows], [0] * len(rows), []
    for a, b in cuts:
        own = [p[a:b] for p in points]
        book = own[:entries]
        for _ in range(rounds):
            book = means(own, [nearest(v, book) for v in own], book)
        for i, v in enumerate(own):
            e = nearest(v, book)
            code[i].append(e)
            error[i] += distance(v, book[e])
        books.append(book)
    return {(r[0], tuple(r[2])): (tuple(c), min(e, 2**63 - 1)) for r, c, e in zip(rows, code, error)}, books


@pytest.mark.parametrize("size,scale,n", [(16, 1.0, 120), (19, 3000.0, 60), (8, 1e9, 40), (5, 1e300, 30)])
def test_codes_equal_plain_integers(spark, size, scale, n):
    rng = np.random.default_rng(size)
    rows = [(i, int(i % 3) if i % 4 else None, (rng.standard_normal(size) * scale).round(3).tolist()) for i in range(n)]
    rows += [(None, 1, rows[0][2]), (7, 1, rows[7][2]), (n + 1, None, [0.0] * size)]
    odd = [(900, 1, None), (901, 1, [1.0, None] + [0.0] * (size - 2)), (902, 1, [float("nan")] * size), (903, 1, [float("inf")] + [0.0] * (size - 1)), (904, 1, []), (905, 1, [1.0])]
    coded, books = vector_codes.compress(spark.createDataFrame(rows + odd, VECTOR).repartition(5))
    got = coded.collect()
    want, plain = plain_codes(rows)
    assert len(got) == len(rows)
    by_label = Counter()
    for r in got:
        by_label[r.label] += r.error
    vectors = {r[0]: tuple(r[2]) for r in rows}
    for r in got:
        assert (tuple(r.code), r.error) == want[r.vec_id, vectors[r.vec_id]]
        assert r.label_error == min(by_label[r.label], 2**63 - 1)
    assert [b.tolist() for b in books.parts] == plain


def test_codes_stand_for_near_vectors(spark):
    rows = [(i, 0, [float(i % 4), 0.25, -1.5, 2.0, 0.0, 1.0, 1.0, float(i % 2)]) for i in range(64)]
    given = spark.createDataFrame(rows, VECTOR)
    good, size = vector_codes.usable(given)
    books = vector_codes.learn(good, size)
    back = vector_codes.decode(vector_codes.encode(good, size, books), size, books).collect()
    assert {r.vec_id: r.approximate for r in back} == {r[0]: r[2] for r in rows} and all(r.error == 0 for r in back)


def test_few_and_no_vectors(spark):
    few, books = vector_codes.compress(spark.createDataFrame([(1, 5, [1.0, 2.0]), (2, 5, [1.0, 2.0])], VECTOR))
    assert [(r.code, r.error, r.label_error) for r in few.collect()] == [([0] * 8, 0, 0)] * 2 and len(books.parts[0]) == 2
    none, _ = vector_codes.compress(spark.createDataFrame([(1, 1, None)], VECTOR))
    assert none.count() == 0


@pytest.mark.parametrize("peak", [3, 2**20, 2**30, 2**31, 2**40, 2**80])
def test_dot_products_are_exact(peak):
    rng = np.random.default_rng(peak % 1000)
    def draw(n):
        return np.array([[int(x * peak) * (1 if rng.random() < 0.5 else -1) + int(rng.integers(3)) for x in rng.random(33)] for _ in range(n)], object)

    left, right = draw(7), draw(5)
    given = [m.astype(np.int64) if peak < 2**60 else m for m in (left, right)]
    assert integers.dots(*given).tolist() == (left @ right.T).tolist()
    assert integers.squared_distances(*given).tolist() == [[distance(a, b) for b in right.tolist()] for a in left.tolist()]
    bits = integers.limb_bits(33)
    for limb in integers.limbs(given[0], bits):
        assert abs(limb).max() <= 2**bits and 33 * 4**bits <= 2**53


def plain_clusters(rows, clusters=16, rounds=3):
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2])
    rows = sorted(rows, key=key)
    points = [fixed(v, 64) for _, _, v in rows]
    centres = points[:clusters]
    for _ in range(rounds):
        centres = means(points, [nearest(p, centres) for p in points], centres)
    of = [nearest(p, centres) for p in points]
    return sorted((str(r[0]), c, distance(p, centres[c])) for r, p, c in zip(rows, points, of)), centres


@pytest.mark.parametrize("spread,scale", [(0.05, 1.0), (1.0, 1.0), (0.3, 1e6), (0.3, 1e15)])
def test_clusters_equal_a_full_scan(spark, spread, scale):
    rng = np.random.default_rng(4)
    middles = rng.standard_normal((12, 64))
    rows = [(i, 0, ((middles[i % 12] + spread * rng.standard_normal(64)) * scale).tolist()) for i in range(150)]
    rows += [(None, 0, rows[3][2]), (5, 0, rows[5][2]), (5, 0, rows[6][2])] + [(1000 + i, 0, [0.5] * 64) for i in range(20)]
    odd = [(900, 0, None), (901, 0, [1.0] * 63), (902, 0, [None] + [1.0] * 63), (903, 0, [float("nan")] * 64)]
    found = centroids.cluster(spark.createDataFrame(rows + odd, VECTOR).repartition(4))
    got = sorted((str(r.vec_id), r.cluster, r.distance) for r in found.vectors.collect())
    want, centres = plain_clusters(rows)
    assert got == [(i, c, min(d, 2**63 - 1)) for i, c, d in want]
    assert found.centroids.tolist() == centres
    assert found.inertias == [sum(d for _, c, d in want if c == k) for k in range(16)]


def test_bounds_spare_most_scans_of_separate_clusters(spark):
    rng = np.random.default_rng(8)
    middles = rng.standard_normal((16, 64)) * 20
    rows = [(i, 0, (middles[i % 16] + 0.2 * rng.standard_normal(64)).tolist()) for i in range(800)]
    found = centroids.cluster(spark.createDataFrame(rows, VECTOR), clusters=16)
    assert found.scanned[0] == 800 and found.scanned[-1] < 200


def test_loosening_is_safe_and_below_full_drift():
    rng = np.random.default_rng(2)
    tighter = 0
    for _ in range(200):
        old = rng.integers(-400, 400, (5, 3))
        new = old + rng.integers(-60, 60, (5, 3))
        radii = rng.random(5) * 200
        loose = centroids.loosening(old, new, radii)
        for c in range(5):
            d = rng.standard_normal((300, 3))
            x = old[c] + d / np.linalg.norm(d, axis=1)[:, None] * radii[c] * rng.random((300, 1)) ** 0.2
            others = [j for j in range(5) if j != c]
            nearer = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
            full = max(np.linalg.norm(new[j] - old[j]) for j in others)
            assert nearer <= loose[c] <= full * (1 + 2 * centroids.MARGIN)
            tighter += loose[c] < 0.9 * full
    assert tighter > 100


def test_no_vectors_and_fewer_than_clusters(spark):
    assert centroids.cluster(spark.createDataFrame([(1, 0, [1.0])], VECTOR)).vectors.count() == 0
    found = centroids.cluster(spark.createDataFrame([(1, 0, [1.0] * 64), (2, 0, [2.0] * 64)], VECTOR))
    assert len(found.centroids) == 2 and {r.distance for r in found.vectors.collect()} == {0}
