import math

import numpy as np
import pytest

from cuesheet.llm.mixing import mix_sources, mixture, plan
from cuesheet.llm.neighbours import chi_square, chi_square_quantile, nearest


def test_mix_is_near_its_targets_and_respects_caps(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 3}") for i in range(900)] + [(1000 + i, "x y", "tiny") for i in range(40)]
    rows += [(5000, None, "s0"), (5001, "", None), (None, "a b c", None), (1, "w w", "s0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as taken")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [0, r.target, r.source_size])
        t[0] += r.taken
    assert abs(sum(t[1] for t in by.values()) - sum(t[2] for t in by.values())) < 1e-6 * 1e5
    # Weights 1, 2, 3, 1, 2 by name, null last; tiny ones stop at three times their size.
    assert by["tiny"][1] == 3 * 80 and by[None][1] == 9
    assert by["s1"][1] == pytest.approx(2 * by["s0"][1]) and by["s2"][1] == pytest.approx(3 * by["s0"][1])
    for taken, target, size in by.values():
        assert abs(taken - target) <= max(200, 0.03 * target)
    again = mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(docs.where("false")).count() == 0


def test_schedule_is_even_everywhere(spark):
    sized = spark.createDataFrame([("a", i, 100) for i in range(200)] + [("b", i, 100) for i in range(400)], "key string, doc_id bigint, size bigint")
    made = plan(sized, (1, 1), 50)
    slots = sorted((r.slot, r.key) for r in made.slots.collect())
    share = sum(k == "a" for _, k in slots) / len(slots)
    for start in range(0, len(slots) - 100, 50):
        assert abs(sum(k == "a" for _, k in slots[start : start + 100]) - 100 * share) <= 4
    words = {r.key: r.w for r in mixture(made).groupBy("key").agg({"words": "sum"}).withColumnRenamed("sum(words)", "w").collect()}
    assert words["a"] == pytest.approx(30_000, rel=0.01) and words["b"] == pytest.approx(30_000, rel=0.01)


def test_chi_square():
    assert chi_square(0, 8) == 0 and abs(chi_square(chi_square_quantile(0.98, 8), 8) - 0.98) < 1e-9
    assert abs(chi_square(7.344, 8) - 0.5) < 1e-3 and math.isclose(chi_square_quantile(0.95, 8), 15.507, rel_tol=1e-3)


def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((1500, 16)).astype("float32")
    v[200:900] = v[200]  # many equal vectors
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] + [1.0] * 15, 0), (2300, [1.0] * 3, 0), (2400, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(5)
    got = nearest(table, 100).collect()
    hits = 0
    for q in range(0, 1500, 100):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hits += len({o[1] for o in own} & set(best))
        assert [o[0] for o in own] == list(range(1, 11))
        assert all(abs(o[2] - d[o[1]]) < 1e-12 for o in own)
        if d[best[-1]] == 0:
            assert [o[1] for o in own] == best
    assert hits >= 0.97 * 150 and {r.query_id for r in got} == set(range(0, 1500, 100))
    assert nearest(table.where("vec_id < 3"), 100).count() == 2
    assert nearest(table.where("false"), 100).count() == 0
    assert nearest(table.where("vec_id in (1, 2)"), 100).count() == 0


def test_neighbours_of_queries_far_from_all_rows(spark):
    # All differences of such a query go one way, so the chi-square stop alone misses all or none.
    rng = np.random.default_rng(7)
    v = rng.standard_normal((12000, 64))
    v[::100] *= 100
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest(table, 100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 12000, 100):
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(12000), d))[:10].tolist()
