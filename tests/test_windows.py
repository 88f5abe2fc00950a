import random

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import windows as W
from cuesheet.ordering import ord_slot

from . import models

FRAME = (
    "video_id string, ord long, timestamp_sec double, section_index int, quality_score double, "
    "is_scene_boundary boolean, t_start double, t_end double, phash long"
)


def frame(video, i, h, quality=1.0, section=0, t=None):
    t = float(i) if t is None else t
    return (video, i, t, section, float(quality), i % 4 == 0, t, t + 2, h)


def test_topic_boundaries(spark):
    axes = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [("v", i, 5.0 * i, 5.0 * i + 5, "x" * 70 if i else "", a) for i, a in enumerate(axes)]
    rows.append(("v", 9, 50.0, 54.0, "short", axes[0]))
    df = spark.createDataFrame(rows, "video_id string, ord long, from_sec double, to_sec double, text string, embedding array<float>")
    got = W.topic_boundaries(df, slot=ord_slot("ord", 2)).orderBy("timestamp_sec").collect()
    assert [(r.timestamp_sec, r.topic_label, r.distance) for r in got] == [(5.0, "x" * 60, 1.0), (10.0, "x" * 60, 1.0)]


def test_drifting_hashes_split_from_the_first_member(spark):
    # Each hash is 6 bits from the last; only the first one is compared.
    hashes, bits = [0], 0
    for i in range(1, 6):
        bits |= ((1 << 6) - 1) << (6 * (i - 1))
        hashes.append(bits)
    df = spark.createDataFrame([frame("v", i, h) for i, h in enumerate(hashes)], FRAME)
    got = {r.ord: r.run_no for r in W.near_duplicate_runs(df, 10).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 1, 1, 2, 2] == models.runs(hashes, 10)


@pytest.mark.parametrize("piece,radius", [(1, 2), (7, 64), (16, 0), (50, 2), (1000, 2)])
def test_runs_do_not_depend_on_the_pieces(spark, piece, radius):
    draw = random.Random(piece * 100 + radius)
    want, rows = {}, []
    for v, n in (("hot", 40 if piece == 1 else 100), ("b", 5), ("c", 1)):
        hashes = [draw.getrandbits(8) - 128 for _ in range(n)]
        rows += [frame(v, i, h) for i, h in enumerate(hashes)]
        for i, no in enumerate(models.runs(hashes, radius)):
            want[v, i] = (no, models.runs(hashes, radius)[-1] + 1)
    df = spark.createDataFrame(rows, FRAME)
    got = W.near_duplicate_runs(df, radius, 10.0, fold_rows=2, piece_rows=piece).collect()
    assert {(r.video_id, r.ord): (r.run_no, r.n_runs) for r in got} == want
    folded = W.near_duplicate_runs(df, radius).collect()
    assert {(r.video_id, r.ord): (r.run_no, r.n_runs) for r in folded} == want


def test_recordings_choose_their_walk_alone(spark, monkeypatch):
    # Small summaries leave pieces that do not tell, static stretches pass through whole pieces.
    monkeypatch.setattr(W, "SUMMARY_ROWS", 3)
    draw = random.Random(9)
    want, rows = {}, []
    for v, n in (("long", 90), ("static", 60), (None, 40), ("short", 4)):
        hashes = [0] * n if v == "static" else [draw.getrandbits(6) if i % 30 < 20 else 0 for i in range(n)]
        rows += [frame(v, i, h) for i, h in enumerate(hashes)]
        for i, no in enumerate(models.runs(hashes, 2)):
            want[v, i] = no
    got = W.near_duplicate_runs(spark.createDataFrame(rows, FRAME), 2, 10.0, fold_rows=5, piece_rows=10).collect()
    assert {(r.video_id, r.ord): r.run_no for r in got} == want


def test_small_pieces_share_a_call(spark, monkeypatch):
    # 70 pieces of one recording in calls of three; the last call has one piece of one frame.
    monkeypatch.setattr(W, "CALL_ROWS", 30)
    draw = random.Random(4)
    hashes = [draw.getrandbits(7) for _ in range(691)]
    df = spark.createDataFrame([frame("v", i, h) for i, h in enumerate(hashes)], FRAME)
    runs = W.near_duplicate_runs(df, 2, 10.0, fold_rows=5, piece_rows=10)
    assert "_call" in runs._jdf.queryExecution().toString()
    got = {r.ord: r.run_no for r in runs.collect()}
    assert [got[i] for i in range(691)] == models.runs(hashes, 2)


def test_signed_hashes_and_missing_ones(spark):
    df = spark.createDataFrame([frame("v", 0, -1), frame("v", 1, -2), frame("v", 2, None), frame("v", 3, 0)], FRAME)
    assert {r.ord: r.run_no for r in W.near_duplicate_runs(df, 10).collect()} == {0: 0, 1: 0, 3: 1}


def test_collapse_keeps_the_first_sharpest_and_the_span(spark):
    df = spark.createDataFrame([frame("v", 1, 0, 5), frame("v", 2, 0, 9), frame("v", 3, 0, 9), frame("v", 8, 255 << 8, 1)], FRAME)
    got = W.collapse_runs(W.near_duplicate_runs(df, 4)).orderBy("ord").collect()
    assert [(r.ord, r.t_start, r.t_end, r.is_scene_boundary, r.run_size) for r in got] == [(2, 1.0, 5.0, False, 3), (8, 8.0, 10.0, True, 1)]


def test_even_parts_are_not_ntile(spark):
    for n, target in [(7, 3), (10, 4), (5, 9), (203, 60), (61, 60)]:
        df = spark.createDataFrame([frame("v", i, 0) for i in range(n)], FRAME)
        got = {r.ord: r.bucket for r in W.even_cut_buckets(df, target, 10.0).collect()}
        assert [got[i] for i in range(n)] == models.even_parts(n, target)
    assert [models.even_parts(7, 3).count(b) for b in range(3)] == [2, 2, 3]
    with pytest.raises(ValueError):
        W.even_bucket(F.lit(0), F.lit(1), 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_downsample_never_blanks_a_tenth(spark, seed):
    draw = random.Random(seed)
    rows = []
    for v in ("a", "b"):
        for i in range(60):
            rows.append(frame(v, i, draw.getrandbits(20), draw.randint(0, 5), min(9, int(i / 60 * 10)) if v == "a" else draw.randint(0, 9)))
    df = spark.createDataFrame(rows, FRAME)
    merged = W.collapse_runs(W.near_duplicate_runs(df, 3))
    two_steps = W.even_cut(merged, 6)
    repaired = W.coverage_repair(merged, two_steps)
    want = {(r.video_id, r.ord, False) for r in two_steps.collect()} | {(r.video_id, r.ord, True) for r in repaired.collect()}
    got = W.downsample(df, 6, 3)
    assert {(r.video_id, r.ord, r.repaired) for r in got.collect()} == want
    tenths = lambda d: {(r.video_id, r.section_index) for r in d.select("video_id", "section_index").collect()}
    assert tenths(got) == tenths(merged)


@pytest.mark.parametrize("seed", range(2))
def test_longest_id_run(spark, seed):
    draw = random.Random(seed)
    numbers = {k: {draw.randint(0, 40) for _ in range(draw.randint(1, 30))} for k in range(6)}
    rows = [(k, f"Q{n}") for k, ns in numbers.items() for n in ns for _ in range(2)] + [(0, "plain"), (1, "Q" + "9" * 60)]
    df = spark.createDataFrame(rows, "k int, node_id string")
    got = {r.k: (r.longest_run, r.overlong) for r in W.longest_id_run(df, ["k"], 8).collect()}
    assert got == {k: (models.longest_run(ns), int(k == 1)) for k, ns in numbers.items()}
    arrays = df.groupBy("k").agg(F.collect_list("node_id").alias("ids")).select("k", W.longest_run_in(F.col("ids")).alias("n"))
    assert {r.k: r.n for r in arrays.collect()} == {k: models.longest_run(ns) for k, ns in numbers.items()}


def test_cap_keeps_the_first_slides(spark):
    df = spark.createDataFrame([frame("v", i, 0) for i in range(30)], FRAME)
    assert sorted(r.ord for r in W.cap_per_recording(df).collect()) == list(range(20))
    assert "WindowGroupLimit" in W.cap_per_recording(df)._jdf.queryExecution().executedPlan().toString()
