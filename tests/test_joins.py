import random

from cuesheet.operators import joins as J
from cuesheet.plans import PLANS

from . import models


def sections(spark, rows):
    return spark.createDataFrame([("v", i, float(a), float(b)) for i, a, b in rows], "video_id string, index int, from_sec double, to_sec double")


def spans(spark, rows):
    return spark.createDataFrame([("v", i, float(a), float(b)) for i, a, b in rows], "video_id string, ord long, t_start double, t_end double")


def points(spark, rows, video="v"):
    return spark.createDataFrame([(video, i, float(t)) for i, t in rows], "video_id string, ord long, timestamp_sec double")


def test_best_overlap_ties_and_touching(spark):
    s = sections(spark, [(0, 0, 10), (1, 10, 20), (2, 30, 40)])
    f = spans(spark, [(0, 5, 15), (1, 20, 20), (2, 25, 28), (3, 9, 15), (4, 35, 50)])
    for width in (3.0, 1000.0):
        got = {r.ord: (r.overlap_section, r.overlap_sec) for r in J.best_overlap(f, s, width).collect()}
        assert got == {0: (0, 5.0), 1: (1, 0.0), 2: (None, None), 3: (1, 5.0), 4: (2, 5.0)}


def test_containment_is_half_open_and_first(spark):
    s = sections(spark, [(3, 0, 10), (4, 5, 20)])
    got = {r.ord: (r.in_section, r.section_matched) for r in J.containing_section(points(spark, [(0, 0), (1, 7), (2, 10), (3, 20)]), s, width=4.0).collect()}
    assert got == {0: (3, True), 1: (3, True), 2: (4, True), 3: (0, False)}


def test_alignment_takes_the_first_point_not_the_nearest(spark):
    got = {r.ord: (r.topic_ord, r.is_topic_aligned) for r in J.topic_alignment(points(spark, [(0, 10), (1, 100)]), points(spark, [(0, 12.9), (1, 10), (2, 10)])).collect()}
    assert got == {0: (0, True), 1: (None, False)}


def test_nearest(spark):
    draw = random.Random(5)
    frames = [(i, draw.randint(0, 200)) for i in range(40)]
    figures = [(i, draw.randint(-20, 260)) for i in range(80)]
    right = points(spark, frames).withColumnsRenamed({"ord": "snapshot", "timestamp_sec": "at"})
    for width in (1.0, 25.0, 1e6):
        got = {r.ord: r.snapshot for r in J.nearest(points(spark, figures), right, "at", "snapshot", "snapshot", width=width).collect()}
        assert got == {i: models.nearest(t, frames) for i, t in figures}
    alone = J.nearest(points(spark, [(1, 5)], "w"), right, "at", "snapshot", "snapshot").collect()
    assert [r.snapshot for r in alone] == [None]


def test_windows_do_not_repeat_frames(spark):
    w = spark.createDataFrame([("v", 0.0, 20.0), ("v", 10.0, 30.0)], "video_id string, lo double, hi double")
    got = sorted(r.ord for r in J.frames_in_windows(points(spark, [(0, 15), (1, 30), (2, 30.5)]), w, 7.0).collect())
    assert got == [0, 1]


def test_midpoints_keep_orphans_on_both_sides(spark):
    got = {(r.ord, r["index"], r.pairing) for r in J.midpoint_sections(spans(spark, [(0, 0, 20), (1, 50, 60)]), sections(spark, [(0, 0, 10), (1, 10, 20), (2, 90, 95)])).collect()}
    assert got == {(0, 0, "paired"), (1, None, "data_only"), (None, 1, "text_only"), (None, 2, "text_only")}


def test_dropped_figures_never_attach(spark):
    f = points(spark, [(0, 5), (1, 300), (2, 5)]).selectExpr("*", "if(ord = 2, 'dropped', 'verified') AS manifest_status")
    got = {r.ord: (r.in_section, r.attached_by) for r in J.attach_figures(f, sections(spark, [(0, 0, 10), (1, 20, 30)])).collect()}
    assert got == {0: (0, "window"), 1: (1, "nearest")}


def test_last_asset_wins_and_tables_are_native(spark):
    refs = spark.createDataFrame([("d", 0, "a", "chart"), ("d", 1, "b", "table"), ("d", 2, "c", "chart"), ("d", 3, "t", "table")], "deck_id string, ref_ord long, figure_id string, kind string")
    assets = spark.createDataFrame([("d", "a", "one", 0), ("d", "a", "two", 1), ("d", "b", "img", 0)], "deck_id string, figure_id string, asset string, ord long")
    tables = spark.createDataFrame([("d", "b", [], [["x"]], 0), ("d", "t", ["h"], [["x"]], 0)], "deck_id string, figure_id string, headers array<string>, rows array<array<string>>, ord long")
    got = {r.figure_id: (r.slide_kind, r.asset) for r in J.resolve_figures(refs, assets, tables).collect()}
    assert got == {"a": ("image", "two"), "b": ("image", "img"), "t": ("table", None)}


def test_time_joins_are_equi_joins(spark, folder):
    for name in ("j2_best_overlap", "j3_containing_section", "j4_topic_alignment", "j5_nearest_frame", "j6_frames_in_windows", "j8_midpoint_sections", "j10_segment_figures"):
        plan = PLANS[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
