import random

import numpy as np
import pyarrow as pa

from cuesheet.llm.bytewords import VISIBLE, distinct, find_words, shingles
from cuesheet.llm.components import components, joined
from cuesheet.llm.line_dedup import aligned_lines, ascending, drop_common_blocks, runs_of_lines
from cuesheet.llm.near_dedup import COMPONENTS, drop_near_duplicates, near_duplicates, signatures
from cuesheet.llm.paragraph_dedup import drop_repeated_paragraphs
from cuesheet.llm.passages import PASSAGE_WORDS, drop_repeated_passages

DOC = "doc_id bigint, text string, n_removed string, component_id int"


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


def similar(rnd, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"c{rnd.randrange(10**6)}"
    return " ".join(w)


def brute(docs):
    sets = []
    for _, t, *_ in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = []
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    top = list(range(len(docs)))
    for _ in range(len(docs)):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return top


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(1)
    base = [words(rnd, n) for n in (3, 40, 80, 120, 300)]
    texts = base + [similar(rnd, t, c) for t in base for c in (0, 1, 2, 4, 8)] + ["", None, " \n", base[0].upper()]
    # A chain: each a step from the one before.
    step = words(rnd, 100)
    for _ in range(12):
        step = similar(rnd, step, 2)
        texts.append(step)
    docs = [(i, t, "x", 5) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(docs, DOC)).collect()}
    assert [got[i].component_id for i in range(len(docs))] == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_one_large_group_with_members_too_different(spark):
    """Copies changed a little to a lot meet in the same buckets, linked or not."""
    rnd = random.Random(3)
    base = words(rnd, 150)
    texts = [similar(rnd, base, k % 12) for k in range(96)]
    docs = [(i, t, "x", 5) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, DOC)).collect()}
    want = brute(docs)
    assert 1 < len(set(want)) < len(docs)
    assert [got[i] for i in range(len(docs))] == want


def test_near_duplicates_with_repeated_and_null_ids(spark):
    t = words(random.Random(2), 30)
    docs = spark.createDataFrame([(4, t, None, 1), (4, t, "a", 1), (None, t, "b", 2), (9, None, None, None), (None, "", None, 3)], DOC)
    assert sorted(str(r.component_id) for r in near_duplicates(docs).collect()) == ["4", "4", "4", "9", "None"]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "9", "None"]
    assert near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_signatures_estimate_similarity_and_are_as_the_sequential_algorithm():
    rnd = random.Random(4)
    base = words(rnd, 400)
    texts = [base, similar(rnd, base, 8), words(rnd, 300), "one", ""]
    hashes, bounds = distinct(*shingles(find_words(pa.array(texts), VISIBLE), 5), len(texts))
    found = signatures(hashes, bounds)
    assert np.isinf(found[4]).all() and np.isfinite(found[:4]).all()
    a, b = (set(hashes[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 1))
    exact = len(a & b) / len(a | b)
    assert abs((found[0] == found[1]).mean() - exact) < 0.15
    assert (found[0] == found[2]).mean() < 0.05
    # One element fills every component once, with one value of each whole part.
    assert sorted(found[3].astype(int)) == list(range(COMPONENTS))
    # All draws, without stopping early, give the same.
    whole = np.minimum.reduce([signatures(np.array([h]), np.array([0, 1]))[0] for h in hashes[bounds[2] : bounds[3]]])
    assert (whole == found[2]).all()


def test_components_of_chains_stars_and_pairs(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, i) for i in range(1001, 1100)]
    links = chain[::-1] + star + [(7, 3), (3, 7), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()}
    assert {got[i] for i in range(100, 401)} == {100} and {got[i] for i in range(1000, 1100)} == {1000}
    assert got[7] == got[3] == 3 and 5 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_take_in_further_links(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)]
    schema = "a bigint, b bigint"
    once = {tuple(r) for r in components(spark.createDataFrame(links, schema)).collect()}
    labels = components(spark.createDataFrame(links[:40], schema))
    # New nodes, links inside a component, a link twice and none at all.
    for part in (links[40:70] + links[:5], links[70:] * 2, []):
        labels = joined(labels, spark.createDataFrame(part, schema))
    got = [tuple(r) for r in labels.collect()]
    assert len(got) == len(set(got)) and set(got) == once


def test_paragraphs(spark):
    rnd = random.Random(6)
    p, q = words(rnd, 60), words(rnd, 30)
    docs = [
        (1, f"{words(rnd, 25)}\n{p}\nshort line", "a", 0),
        (2, f"{similar(rnd, p, 1)}\nshort line\n{q}\n{q}", "a", 0),
        (3, similar(rnd, words(rnd, 60), 0), "a", 0),
        (None, q, None, None),
        (4, None, None, None),
        (5, "", None, None),
    ]
    got = {r.doc_id: r for r in drop_repeated_paragraphs(spark.createDataFrame(docs, DOC)).collect()}
    assert got[1].removed is None and got[1].text == docs[0][1] and got[1].n_paragraphs == 3
    assert got[2].removed == [0, 3] and got[2].text == f"short line\n{q}" and got[2].n_removed == 2
    assert got[None].text == "" and got[4].text is None and got[5].text == "" and got[3].n_removed == 0
    assert got[4].n_paragraphs == 0 and got[4].component_id is None
    assert drop_repeated_paragraphs(spark.createDataFrame([], DOC)).count() == 0


def passages_by_hand(docs):
    """Repeated words, removed words and rest of each text of rows (id, text) in order of ids."""
    split = [(t or "").lower().split() for _, t in docs]
    holders = {}
    for d, w in enumerate(split):
        for i in range(len(w) - PASSAGE_WORDS + 1):
            holders.setdefault(tuple(w[i : i + PASSAGE_WORDS]), []).append(d)
    out = []
    for d, (w, (_, text)) in enumerate(zip(split, docs, strict=True)):
        repeated, removed = set(), set()
        for i in range(len(w) - PASSAGE_WORDS + 1):
            at = holders[tuple(w[i : i + PASSAGE_WORDS])]
            if at[0] != at[-1]:
                repeated.update(range(i, i + PASSAGE_WORDS))
                removed.update(range(i, i + PASSAGE_WORDS) if at[0] != d else ())
        rest = None if text is None else " ".join(x for i, x in enumerate(text.split()) if i not in removed)
        out.append((sorted(repeated), sorted(removed), rest))
    return out


def test_passages_inside_lines(spark):
    rnd = random.Random(12)
    p, q, hot, loop = words(rnd, 90), words(rnd, 51), words(rnd, 60), "lorem ipsum " * 70
    docs = []
    for k in range(120):
        # Passages whole, cut, a word changed, in capitals, at any place of texts without line breaks.
        inner = [words(rnd, rnd.randrange(70))]
        for _ in range(rnd.randrange(3)):
            part = rnd.choice([p, q, hot, hot, loop]).split()
            a = rnd.choice([0, 0, rnd.randrange(40)])
            part = part[a : rnd.choice([len(part), len(part), a + rnd.randrange(30, 80)])]
            inner += [similar(rnd, " ".join(part), rnd.choice([0, 0, 1])), words(rnd, rnd.randrange(70))]
        text = " ".join(x for x in inner if x)
        docs.append((k, text.upper() if k % 9 == 0 else text))
    # Twice in one text only, exact copies, 50 words only, other scripts, nothing.
    twice, wide = words(rnd, 60), " ".join(f"слово{rnd.randrange(999)}é" for _ in range(55))
    docs += [(200, f"{twice} x {twice}"), (201, docs[5][1]), (202, docs[5][1]), (203, " ".join(p.split()[:50]) + " y")]
    docs += [(204, f"a {wide}"), (205, f"{wide} b"), (206, None), (207, ""), (208, "few words"), (None, f"z {p} z")]
    want = passages_by_hand(docs)
    rows = [(d, t, None, 7) for d, t in docs]
    rnd.shuffle(rows)
    got = {r.doc_id: r for r in drop_repeated_passages(spark.createDataFrame(rows, DOC)).collect()}
    assert len(got) == len(docs) and any(w[1] for w in want)
    for (d, text), (repeated, removed, rest) in zip(docs, want, strict=True):
        r = got[d]
        assert [i for a, b in r.repeated for i in range(a, b)] == repeated and r.n_repeated == len(repeated)
        assert [i for a, b in r.removed for i in range(a, b)] == removed and r.n_removed == len(removed)
        assert r.n_words == len((text or "").split()) and r.component_id == 7
        assert r.text == rest if rest is None else r.text.rstrip() == rest
    assert got[200].n_repeated == 0 and got[205].n_removed == 55 and got[204].n_removed == 0 and got[204].n_repeated == 55
    assert got[None].text == "z z" and drop_repeated_passages(spark.createDataFrame([], DOC)).count() == 0


def test_lines(spark):
    rnd = random.Random(8)
    a = [words(rnd, 12) for _ in range(6)]
    new = [words(rnd, 12) for _ in range(3)]
    docs = [
        (1, "\n".join(a), None, 1),
        (2, "\n".join([new[0], *a[1:4], "ok", new[1]]), None, 1),
        (3, "\n".join([a[5], new[2], a[0]]), None, 1),  # turned around: only one of both is aligned
        (3, "\n".join([a[5], new[2], a[0]]), None, 1),
        (5, "ok\n \n", None, None),
        (6, None, None, None),
        (None, "\n".join(a), "x", None),
    ]
    got = drop_common_blocks(spark.createDataFrame(docs, DOC)).collect()
    text = {}
    for r in got:
        text.setdefault(r.doc_id, []).append(r.text)
    assert text[1] == [docs[0][1]] and text[None] == [""] and text[6] == [None] and text[5] == ["ok\n \n"]
    assert text[2] == ["\n".join([new[0], "ok", new[1]])]
    # The first of the repeated rows keeps what is new in it, the second keeps nothing.
    assert len(text[3]) == 2 and all(new[2] in t or t == "" or a[0] in t for t in text[3])
    assert drop_common_blocks(spark.createDataFrame([], DOC)).count() == 0


def test_alignment_is_patience():
    assert ascending([(0, 3), (1, 1), (2, 2), (3, 9), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    line = lambda i, j, **k: {"i": i, "j": j, "chars": 40, "partner": 1, "once": True, "df": 2, "before": None, "after": None, "holder_before": None, "holder_after": None} | k
    assert aligned_lines([line(0, 4), line(1, 5)]) == [0, 1]
    assert aligned_lines([line(0, 4), line(1, 6)]) == []
    # A line between, held earlier by a third document, is part of the block.
    third = line(1, 0, partner=0, df=900)
    assert aligned_lines([line(0, 4, after=7, holder_after=7), third, line(2, 6)]) == [0, 1, 2]


def test_blocks_whose_lines_third_documents_had_first(spark):
    """Two and three short lines, each first held by another document, shared as a block later on."""
    short = [f"line {k} of thirty-one characters" for k in range(5)]
    docs = [(k, f"{short[k]}\nalone {k}", None, 1) for k in range(5)]
    docs += [(10, "\n".join(["ten", *short[:2], "x", *short[2:]]), None, 1), (11, "\n".join([*short[:2], "eleven", *short[2:]]), None, 1)]
    # Neighbours on either side of a blank line are no block.
    docs += [(12, f"{short[0]}\n\n{short[1]}", None, 1)]
    got = {r.doc_id: r for r in drop_common_blocks(spark.createDataFrame(docs, DOC)).collect()}
    assert got[11].text == "eleven" and got[11].removed == [0, 1, 3, 4, 5]
    assert all(got[i].text == t for i, t, *_ in docs if i != 11)


def test_runs_cover_every_block():
    rnd = random.Random(12)
    chars = np.array([rnd.choice([0, 1, 9, 25, 40, 70]) for _ in range(400)])
    first, k, code = runs_of_lines(np.arange(400) % 7, chars, np.arange(400) // 90)
    runs = set(zip(first.tolist(), k.tolist()))
    assert all(chars[i : i + n].sum() >= 60 and chars[i : i + n].min() > 0 and i // 90 == (i + n - 1) // 90 for i, n in runs)
    runs |= {(i, 1) for i in range(400) if chars[i] >= 60}
    for i in range(400):
        for n in range(1, 12):
            if i + n <= 400 and i // 90 == (i + n - 1) // 90 and chars[i : i + n].min() > 0 and chars[i : i + n].sum() >= 60:
                covered = {x for a, b in runs if i <= a and a + b <= i + n for x in range(a, a + b)}
                assert covered == set(range(i, i + n))
    # Equal runs have equal hashes wherever they stand.
    again = {(i % 90, n): h for i, n, h in zip(*runs_of_lines(np.tile(np.arange(90), 2), np.full(180, 25), np.arange(180) // 90))}
    assert len(set(again.values())) == len(again) == 88


def test_lines_that_repeat_in_one_document(spark):
    rnd = random.Random(13)
    p, q, r = (words(rnd, 14) for _ in range(3))
    docs = [
        (1, "\n".join([p, q, "one", p, q]), None, 1),  # a passage twice
        (2, "\n".join(["two", p, q]), None, 1),
        (3, "\n".join([p, "three", q, p, q, p, q]), None, 1),  # more often than the first
        (4, "\n".join([r] * 4), None, 1),  # nothing but repeats
        (5, "\n".join([r] * 4), None, 1),
        (6, "\n".join([r] * 6), None, 1),
    ]
    got = {r.doc_id: r for r in drop_common_blocks(spark.createDataFrame(docs, DOC)).collect()}
    assert got[1].removed is None and got[4].removed is None
    assert got[2].text == "two" and got[5].text == "" and got[6].n_removed == 4
    # As many of each as the first document has.
    left = got[3].text.split("\n")
    assert "three" in left and left.count(p) == 1 and left.count(q) == 1
