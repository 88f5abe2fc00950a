import json

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import structs, text, timeline
from cuesheet.operators import classify, gates, generators, jobs, ranking, replies

from . import models


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_cosine_distance(spark):
    d = timeline.cosine_distance
    r = one(spark, same=d(arr(1, 2), arr(1, 2)), cross=d(arr(1, 0), arr(0, 1)), zero=d(arr(0, 0), arr(1, 1)), odd=d(arr(1), arr(1, 2)), none=d(F.array().cast("array<double>"), F.array().cast("array<double>")))
    assert r.same == pytest.approx(0, abs=1e-12) and (r.cross, r.zero, r.odd, r.none) == (1.0, 1.0, 1.0, 1.0)


def test_times_and_names(spark):
    r = one(spark, long=timeline.minutes_seconds(F.lit(7265.0)), even=timeline.minutes_seconds(F.lit(2.5)), name=timeline.keyframe_name(F.lit(3), F.lit(0.0), F.lit(61.4)),
            last=timeline.decile(F.lit(10.0), F.lit(10.0)), none=timeline.decile(F.lit(3.0), F.lit(0.0)))
    assert tuple(r) == ("121m05s", "00m02s", "keyframe_0003_[00m00s-01m01s].jpeg", 9, 0)


def test_value_labels(spark):
    values = [3.0, 0.5, 12.3456, 0.00012345, 12345.6, -2.0, 1234.56]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(timeline.value_label(F.col("v"))).collect()]
    assert got == [str(int(v)) if v == int(v) else f"{v:.4g}" for v in values]


def test_clip_and_sentences(spark):
    r = one(spark, short=text.clip_words(F.lit("abc"), 5), word=text.clip_words(F.lit("alpha beta gamma"), 12), hard=text.clip_words(F.lit("ab cdefghijklmnop"), 10),
            first=text.first_sentence(F.lit("One. Two")), kept=text.narrative_sentences(F.lit("Short. This one is long enough. 이것은 충분히 긴 문장입니다 끝")),
            clean=text.subject_text(F.lit("이 영상에서는 café   테스트")), hit=text.meta_hit(F.lit("영상 제작은 좋다")), src=text.meta_hit(F.lit("본 강의")), clock=text.meta_hit(F.lit("at 1:23")))
    assert (r.short, r.word, r.hard, r.first) == ("abc", "alpha beta", "ab cdefghi", "One.")
    assert r.kept == ["This one is long enough.", "이것은 충분히 긴 문장입니다"]
    assert (r.clean, r.hit, r.src, r.clock) == ("café 테스트", None, "본 강의", "1:23")


BOXES = {
    "text": ([("plain text", 40, 20, 0.3)], True),
    "strong": ([("figure", 10, 10, 0.8)], True),
    "large": ([("figure", 50, 50, 0.3), ("title", 1, 1, 0.9)], True),
    "lecturer": ([("figure", 50, 50, 0.3)], False),
    "sliver": ([("plain text", 10, 9, 0.9)], False),
    "chrome": ([("abandon", 90, 90, 0.9)], False),
    "unknown": ([("person", 90, 90, 0.9)], False),
}


def test_content_gate(spark):
    rows = [(k, c, float(w), float(h), s, 100, 100) for k, (bs, _) in BOXES.items() for c, w, h, s in bs]
    df = spark.createDataFrame(rows, "frame_id string, cls string, w double, h double, score double, img_w int, img_h int")
    got = {r.frame_id: r.has_content for r in gates.frame_content(df).collect()}
    assert {k: got.get(k, False) for k in BOXES} == {k: want for k, (_, want) in BOXES.items()}


def test_frame_gate_keeps_errors_and_starved_recordings(spark):
    frames = spark.createDataFrame([("a", "f1", True, 1.0), ("a", "f2", False, 1.0), ("a", "f3", False, 0.0), ("b", "f4", False, 1.0)], "video_id string, frame_id string, detect_error boolean, frame_area double")
    content = spark.createDataFrame([("zz", 1, 0, True)], "frame_id string, content_boxes long, fig_box_count long, has_content boolean")
    got = {r.frame_id: (r.keep, r.starved) for r in gates.gate_frames(frames, content).collect()}
    assert got == {"f1": (True, False), "f2": (False, False), "f3": (True, False), "f4": (True, True)}


def test_crop_gate_order(spark):
    chart = json.dumps({"insight": "Uniform load", "series": [{"points": [{"y": 1}, {"value": 2}, {"y": "3"}]}]})
    flat = json.dumps({"insight": "uniform", "series": [{"points": [{"y": 1}, {"y": "2"}]}]})
    phantom = json.dumps({"diagram_type": "flow", "nodes": [{"id": "a"}], "edges": [{"from": "a", "to": "b"}]})
    base = dict(x=0.0, y=0.0, w=10.0, h=10.0, img_w=100, img_h=100, kind="chart", kind_second="chart", confidence=0.9, struct=None)
    cases = {
        "empty_crop": dict(x=200.0), "oversize": dict(w=95.0, h=95.0, kind="photo"), "reject_kind": dict(kind="photo", kind_second="chart"),
        "kinds_disagree": dict(kind_second="table", confidence=0.1), "low_confidence": dict(confidence=None), "chart_inconsistent": dict(struct=chart),
        "diagram_inconsistent": dict(kind="diagram", kind_second="diagram", struct=phantom), "none": dict(struct=flat),
    }
    rows = [(k, *{**base, **v}.values()) for k, v in cases.items()]
    df = spark.createDataFrame(rows, "id string, x double, y double, w double, h double, img_w int, img_h int, kind string, kind_second string, confidence double, struct string")
    got = {r.id: r.reason or "none" for r in df.select("id", gates.crop_reason().alias("reason")).collect()}
    assert got == {k: k for k in cases}


def test_struct_rules(spark):
    r = one(spark, two=structs.diagram_is_dense(F.from_json(F.lit('{"nodes":[{"id":1},{"id":2},{"x":1}]}'), structs.DIAGRAM)["nodes"]),
            three=structs.diagram_is_dense(F.from_json(F.lit('{"nodes":[{"id":1},{"id":2},{"id":3}]}'), structs.DIAGRAM)["nodes"]),
            line=structs.chart_is_informative(F.lit("line"), arr(2, 2)), bar=structs.chart_is_informative(F.lit("bar"), arr(2, 2)),
            spread=structs.bar_spread(F.lit(1), arr(1, 12, -5), 12.0), fit=structs.fit_row(F.array(F.lit("a")), F.lit(3)), cut=structs.fit_row(F.array(F.lit("a"), F.lit("b")), F.lit(1)))
    assert tuple(r) == (False, True, False, True, True, ["a", "", ""], ["a"])


@pytest.mark.parametrize("raw,ok", [('{"a": 1}', True), ('{"a": 1}}', False), ("[1, 2", False), ("1, 2", False), ("", False), ("[1],[2]", False), ("null", True), ('"x"', True), ("1],[2", False)])
def test_strict_json(spark, raw, ok):
    r = one(spark, strict=structs.strict_json(F.lit(raw)).isNotNull(), valid=structs.is_json(F.lit(raw)))
    assert tuple(r) == (ok, ok)


def test_relevance_and_tiers(spark):
    r = one(spark, edge=gates.relevance_path(F.lit(60), F.lit(True)), under=gates.relevance_path(F.lit(59.9), F.lit(True)), plain=gates.relevance_path(F.lit(90), F.lit(False)),
            stage=gates.failure_stage(F.lit("recognize")), odd=gates.failure_stage(F.lit("upload")), empty=text.edit_share(F.lit(""), F.lit("")))
    assert tuple(r) == ("path1_figure", "path2_text", "path2_text", "numerize", None, 0.0)


def test_scene_samples(spark):
    scenes = [("v", i, float(a), float(b)) for i, (a, b) in enumerate([(0, 2), (2, 30), (30, 900), (900, 899), (0, 2.6)])]
    df = spark.createDataFrame(scenes, 'video_id string, ord long, start double, end double')
    got = {}
    for r in generators.scene_samples(df).orderBy("ord", "sample").collect():
        got.setdefault(r.ord, []).append(r.timestamp_sec)
    assert got == {i: pytest.approx(models.scene_times(a, b)) for _, i, a, b in scenes}


def test_body_pages_fill_thin_pages_in_order(spark):
    rows = [("d", "t", "n", [f"atom {i}" for i in range(13)], ["x" * 120, "atom 3", "y" * 50, "z" * 20]), ("e", "", "", [], [])]
    df = spark.createDataFrame(rows, "deck_id string, title string, narrative string, atoms array<string>, sentences array<string>")
    got = {(r.deck_id, r.page): r.bullets for r in generators.body_pages(df).collect()}
    assert [len([b for b in got["d", p] if b.startswith("atom")]) for p in range(3)] == [5, 5, 3]
    assert got["d", 0][5:] == ["x" * 120] and got["d", 2][3:] == ["x" * 120, "y" * 50] and got["e", 0] == ["—"]


def test_run_report_numbers(spark):
    rows = [("r", True, 2, None, None, 1, 5), ("r", True, 2, None, None, 1, 5), ("r", True, 2, None, None, 1, 5), ("r", False, 3, "validate", "x", 0, 0), ("s", False, 1, None, "crash", 0, 0)]
    df = spark.createDataFrame(rows, "report string, validate_pass boolean, attempts int, failure_stage string, error string, conf_below int, conf_total int")
    g = {r.report: r for r in jobs.run_gates(df, ["report"]).collect()}
    assert (g["r"].pass_ratio, g["r"].g1_pass, g["r"].mean_attempts, g["r"].g2_pass, g["r"].conf_share) == (0.75, False, 2.0, True, 0.2)
    assert (g["s"].n_completed, g["s"].mean_attempts, g["s"].g2_pass, g["s"].conf_share) == (0, 0.0, False, None)
    stages = spark.createDataFrame([("x", s, None) for s in ("detect", "numerize", "validate", "acquire", None)], "report string, failure_stage string, error string")
    assert {r.family: r.n_runs for r in jobs.failure_families(stages, ["report"]).collect()} == {"recognition": 2, "build": 1, "other": 1, "none": 1}
    empty = jobs.empty_gates_row(jobs.run_gates(df.where("false"), [])).first()
    assert (empty.g1_pass, empty.g2_pass, empty.n_runs) == (False, False, 0)


def test_figure_frame_beats_text_frame(spark):
    df = spark.createDataFrame([("v", 0, 5.0, 0), ("v", 1, 30.0, 2)], "video_id string, ord long, timestamp_sec double, fig_box_count int")
    assert [r.ord for r in ranking.request_frames(df).orderBy("rank").collect()] == [1, 0]


def test_slide_files_in_numeric_order(spark):
    df = spark.createDataFrame([("ppt/slides/slide10.xml",), ("ppt/slides/slide2.xml",)], "f string")
    assert [r.f for r in df.orderBy(ranking.slide_number(F.col("f"))).collect()] == ["ppt/slides/slide2.xml", "ppt/slides/slide10.xml"]


def test_deck_types(spark):
    df = spark.createDataFrame([(0, "Top 10 tools", None, None), (1, "", "", ""), (2, "Interview", "podcast guest", "? " * 9)], "id long, title string, description string, transcript string")
    got = {r.id: r for r in classify.pick_type(classify.type_scores(df)).collect()}
    assert got[0].type == "listicle" and (got[1].type, got[1].confidence) == ("explainer", 0.2)
    assert got[2].type == "interview" and got[2].scores.interview == 9
    opinions = spark.createDataFrame([(1, "essay", 0.8)], "id long, second_type string, second_confidence double")
    routed = {r.id: (r.routed_type, r.routed_confidence, r.source) for r in classify.route(classify.pick_type(classify.type_scores(df)), opinions, "id").collect()}
    assert routed[1] == ("explainer", 0.8, "second") and routed[2][2] == "heuristic"


def test_deck_types_of_the_whole_transcript(spark):
    late = "word " * 1000 + "podcast " + "? " * 8
    df = spark.createDataFrame([(0, "", "", late)], "id long, title string, description string, transcript string")
    assert classify.type_scores(df).first().scores.interview == 3
    assert classify.type_scores(df, 4000).first().scores.interview == 0
    assert classify.type_scores(df, 5008).first().scores.interview == 1


def test_salvage_keeps_only_complete_elements(spark):
    doc = {"kind": "diagram", "struct": {"nodes": [{"id": "a", "label": 'x "]} \\'}, {"id": "b"}], "n": [1, 2]}}
    whole = json.dumps(doc)
    fixed = {
        '{"a": 1': None,
        '```json\n[{"a": 1}, {"b": 2': '[{"a": 1}]',
        '{"a": 1} ] {"b": [': '{"a": 1}',
        '[[1, 2], "\U0001f600 \\" }", {"b": "}': "[[1, 2]]",
        '[{"k": "\\\\"}, {"k": "]': '[{"k": "\\\\"}]',
        "": None,
    }
    raws = [whole[:-cut] for cut in range(1, 60)] + list(fixed) + [None]
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    got = {r.raw: r.part for r in df.select("raw", replies.complete_prefix(replies.unfenced(F.col("raw"))).alias("part")).collect()}
    for raw, part in fixed.items():
        assert got.pop(raw) == part
    assert got.pop(None) is None
    for part in got.values():
        if part is not None:
            nodes = json.loads(part).get("struct", {}).get("nodes", [])
            assert nodes == doc["struct"]["nodes"][: len(nodes)]
    # Cut between the last brackets, everything is there.
    assert [json.loads(got[whole[:-cut]]) == doc for cut in (1, 2, 3)] == [True, True, False]


def test_salvage_and_overgeneration(spark):
    def reply(n, step):
        return json.dumps({"struct": {"nodes": [{"id": f"Q{i * step}"} for i in range(n)]}})[:-2]

    rows = [(0, reply(3, 1), "length"), (1, reply(6, 1), "length"), (2, reply(6, 2), "length"), (3, reply(31, 5), "length"), (4, reply(3, 1), "stop"), (5, '```json\n{"a": 1}\n```', "stop"), (6, None, "length")]
    df = spark.createDataFrame(rows, "reply_id long, raw string, finish_reason string")
    got = {r.reply_id: (r.outcome, r.overgenerated) for r in replies.overgenerated(replies.salvage_truncated(df)).collect()}
    assert got == {0: ("salvaged", False), 1: ("salvaged", True), 2: ("salvaged", False), 3: ("salvaged", True), 4: ("unreadable", False), 5: ("complete", False), 6: ("unreadable", False)}


def test_stat_repair(spark):
    rows = [(0, '{"metrics": {"a": 1, "deep": {"x": 1}}}'), (1, '{"metrics": ["s", 2, [1], {"k": true}, {"value": 3, "label": "l"}]}'), (2, '{"metrics": "bare"}'), (3, '```json\n{"metrics": ["f"]}\n```'), (4, "prose")]
    df = spark.createDataFrame(rows, "id long, raw string")
    got = [(r.id, r.pos, r.label, r.value) for r in replies.stat_rows(df, "id").orderBy("id", "pos").collect()]
    assert got == [(0, 0, "a", "1"), (1, 0, "", "s"), (1, 1, "", "2"), (1, 2, "k", "true"), (1, 3, "l", "3"), (3, 0, "", "f")]
