import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from cuesheet.llm.bytewords import ALPHANUMERIC, VISIBLE, distinct, find_words, pieces, shingles

TEXTS = ["", None, "One two", "  x\ty\n", "Ärger-free ÉTÉ 1.5", "a", "\x1c b\x00c", "tail", "z" * 500 + " end"]


def test_words_follow_the_patterns():
    for table, pattern in ((ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (VISIBLE, r"[^\x20\x09-\x0D]+")):
        lower = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in TEXTS]
        want = [re.findall(pattern, t) for t in lower]
        words = find_words(pa.array(TEXTS, pa.string()), table)
        data = bytes(words.data)
        got = [
            [data[words.start[i] : words.end[i]].decode() for i in range(words.first[t], words.first[t + 1])]
            for t in range(len(TEXTS))
        ]
        assert got == want
        by_word = {}
        for w, h in zip([w for ws in got for w in ws], words.hash.tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_slices_and_pieces_cover_everything():
    column = pa.array(TEXTS * 3, pa.string())
    batch = pa.RecordBatch.from_arrays([column, pa.array(range(len(column)))], ["text", "n"])
    got = [n for p in pieces(batch, "text", 8) for n in p.column("n").to_pylist()]
    assert got == list(range(len(column)))
    a = find_words(column.slice(2, 5), VISIBLE)
    b = find_words(pa.array(TEXTS[2:7], pa.string()), VISIBLE)
    assert (a.hash == b.hash).all() and (a.first == b.first).all()


def test_distinct_shingles_are_those_of_python_sets():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    words = find_words(pa.array(texts), VISIBLE)
    hashes, bounds = distinct(*shingles(words, 5), len(texts))
    seen = {}
    for i, t in enumerate(texts):
        w = t.split()
        want = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        own = set(hashes[bounds[i] : bounds[i + 1]].tolist())
        assert len(own) == len(want)
        seen[frozenset(want)] = seen.get(frozenset(want), own)
        assert seen[frozenset(want)] == own
    assert np.diff(bounds).sum() == len(hashes)


def test_words_of_a_piece_take_little_memory():
    texts = pa.array([f"word{i % 97} " * 600 for i in range(250)])
    tracemalloc.start()
    try:
        find_words(texts, VISIBLE)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 30 * texts.nbytes
