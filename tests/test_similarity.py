"""Similarity clusters and components against brute force."""

import numpy as np
import pytest

from cuesheet.operators import similarity, topics
from cuesheet.operators.components import components

POINT = "sector string, id long, v array<double>"


def brute(rows, threshold):
    """Smallest id reachable through cosines of at least the threshold, sector by sector."""
    label = {i: i for _, i, _ in rows}
    ids = [i for _, i, v in rows if v is not None]
    known = {i: (s, np.array(v) / np.linalg.norm(v)) for s, i, v in rows if v is not None}
    links = [(a, b) for a in ids for b in ids if a < b and known[a][0] == known[b][0] and known[a][1] @ known[b][1] >= threshold]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def sample(seed, n, size=24, noise=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 5, size))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + noise * rng.standard_normal(size)
        rows.append((["a", "b", None][int(rng.integers(3))], i, v.tolist()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force(spark, seed):
    rows = sample(seed, 300)
    got = {r.id: r.cluster for r in similarity.similar_clusters(spark.createDataFrame(rows, POINT), ["sector"], "id", "v", 0.85).collect()}
    want = brute(rows, 0.85)
    assert len(set(want.values())) > 20 and got == want


def test_crowded_buckets_are_compared_in_blocks(spark, monkeypatch):
    # Blocks of 16: nearly every bucket is crowded, and most are of several components.
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rows = sample(3, 400, size=6, noise=0.15)
    got = {r.id: r.cluster for r in similarity.similar_clusters(spark.createDataFrame(rows, POINT), ["sector"], "id", "v", 0.95).collect()}
    assert got == brute(rows, 0.95)


def test_near_copies_on_two_sides_of_a_plane_share_a_cluster(spark):
    # Signs of every component differ in pairs, whatever the planes are some pair is cut by them.
    base = np.random.default_rng(5).standard_normal((40, 16))
    rows = [("s", 2 * i + k, (v * (1 + 0.02 * k * np.arange(16) % 3)).tolist()) for i, v in enumerate(base) for k in (0, 1)]
    got = {r.id: r.cluster for r in similarity.similar_clusters(spark.createDataFrame(rows, POINT), ["sector"], "id", "v").collect()}
    assert got == {i: i // 2 * 2 for i in range(80)}


def test_vectors_without_direction_stand_alone(spark):
    rows = [("s", 1, None), ("s", 2, []), ("s", 3, [0.0, 0.0]), ("s", 4, [float("nan"), 1.0]), ("s", 5, [1.0]), ("s", 6, [2.0]), ("s", 7, [1.0, None]), ("s", 8, [1e300, 1e300]), ("s", 9, [1e-300, 1e-300])]
    got = {r.id: r.cluster for r in similarity.similar_clusters(spark.createDataFrame(rows, POINT), ["sector"], "id", "v").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8}
    none = similarity.similar_clusters(spark.createDataFrame([], POINT), ["sector"], "id", "v")
    assert none.count() == 0 and none.columns == ["sector", "id", "v", "cluster"]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 300)]
    hub = [(1000, i) for i in range(1001, 1400)]
    links = spark.createDataFrame(chain + hub + [(5, 5), (300, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {7: 7, **{i: 7 for i in range(100, 301)}, **{i: 1000 for i in range(1000, 1400)}}


def test_copies_form_one_common_cluster(spark):
    rows = [("s", v, i, 10, [1.0, 2.0, 3.0, 4.0]) for i, v in enumerate("aab")] + [("s", "c", 9, 99, [-1.0, -2.0, -3.0, -4.0])]
    df = spark.createDataFrame(rows, "sector_id string, video_id string, ord long, relevance_pct int, embedding array<float>")
    got = {r.kind: (r.n_points, r.n_videos, r.video_id) for r in topics.common_and_distinctive(df, 5).collect()}
    assert got == {"common": (3, 2, "a"), "distinctive": (1, 1, "c")}


def test_bands_of_a_large_group_stay_few():
    # A row goes out once a band: 55 bands for a group of 250,000 vectors before.
    bits, bands = similarity.band_plan(250_000, 0.9, 1e-4)
    assert bands <= 35 and 250_000 / 2**bits <= similarity.BLOCK


def test_cosines_next_to_the_threshold_are_settled_in_64_bits(spark, monkeypatch):
    # Pairs at 1e-9 on either side of the threshold: 32 bits cannot tell them apart. Small calls, so buckets are split among many.
    monkeypatch.setattr(similarity, "CALL_ROWS", 8)
    rows, want = [], {}
    for i in range(40):
        cosine = 0.9 + (1e-9 if i % 2 else -1e-9)
        base, other = np.linalg.qr(np.random.default_rng(i).standard_normal((48, 2)))[0].T
        rows += [(f"s{i}", 2 * i, base.tolist()), (f"s{i}", 2 * i + 1, (cosine * base + np.sqrt(1 - cosine**2) * other).tolist())]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + 1 - i % 2}
    got = {r.id: r.cluster for r in similarity.similar_clusters(spark.createDataFrame(rows, POINT), ["sector"], "id", "v").collect()}
    assert got == want
