import random

import pytest

from cuesheet.llm.decontaminate import build_index, clean, contamination, proximity_matches

DOC, ITEM = "doc_id bigint, text string, items string", "item_id bigint, text string, doc_id int"


def test_hits_equal_brute_force(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(["ab", "Cd", "é", "x1"]) for _ in range(n))
    docs = [(i, text(rnd.randrange(0, 60)), "x") for i in range(40)] + [(7, None, None), (None, text(30), None), (41, "", None)]
    items = [(i, text(rnd.randrange(1, 8)), 0) for i in range(25)] + [(30, None, 0), (31, " .,", 0), (32, docs[3][1], 0)]
    got = contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), size=5).collect()

    def expected(t):
        w = (t or "").lower().split()
        hit, found = set(), set()
        for item, it in ((i, (x or "").lower().replace(".", " ").replace(",", " ").split()) for i, x, _ in items):
            n = min(5, len(it))
            for k in range(len(it) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == it[k : k + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        return len(w), len(hit), sorted(map(str, found))

    want = sorted((d is None, d or 0, *expected(t)) for d, t, _ in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.hit_items or []) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_proximity_and_clean(spark):
    docs = spark.createDataFrame([(1, "a b x c", "k"), (2, "c q a", "k"), (3, "a - z z z z c", "k"), (4, None, None)], DOC)
    index = build_index(docs)
    near = {(r.doc_id, r["at"]) for r in proximity_matches(index, [("q", "a c")], 4).collect()}
    assert near == {(1, 0), (2, 0)}
    with pytest.raises(ValueError):
        proximity_matches(index, [("q", "a")], 1000)
    kept = clean(docs, spark.createDataFrame([(0, "a b x", 0)], ITEM)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 4] and kept[0].items in ("k", None)


def test_empty_tables(spark):
    none, item = spark.createDataFrame([], DOC), spark.createDataFrame([(0, "a", 0)], ITEM)
    assert contamination(none, item).count() == 0
    some = contamination(spark.createDataFrame([(1, "a", "")], DOC), spark.createDataFrame([], ITEM)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in some] == [(1, 0, False)]
