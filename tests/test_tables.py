"""Sinks, readers and the streaming job log."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cuesheet.operators import audits, decks, jobs
from cuesheet.plans.bindings import job_events_of
from cuesheet.sources import readers, sinks
from cuesheet.sources.store import Store
from cuesheet.streaming.jobs import read_job_state, start_job_state, sweep_job_state

DECK = "video_id string, generator_version string, deck_id string, lang string, v2_fingerprint string, slide_count int, status string, error string, user_id string"


def test_upsert_resets_and_is_repeatable(spark):
    old = spark.createDataFrame([("v1", "g", "d1", "ko", "f", 3, "error", "boom", "u1"), ("v2", "g", "d2", "ko", "f", 3, "done", None, "u2")], DECK)
    new = spark.createDataFrame([("v1", "g", "x1", "en", "f2", 5, None, None, None), ("v3", "g", "d3", "en", "f3", 1, None, None, "u3")], DECK)
    once = sinks.upsert_decks(old, new)
    row = {r.video_id: r for r in once.collect()}
    assert (row["v1"].deck_id, row["v1"].status, row["v1"].error, row["v1"].user_id, row["v1"].created) == ("d1", "building", None, "u1", False)
    assert (row["v2"].status, row["v2"].created) == ("done", False) and row["v3"].created
    twice = sinks.upsert_decks(once.select(*old.columns), new)
    assert sorted(map(str, twice.drop("created").collect())) == sorted(map(str, once.drop("created").collect()))


def test_replace_covers_decks_without_new_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "deck_id string, n int")
    new = spark.createDataFrame([("a", 2)], "deck_id string, n int")
    rebuilt = spark.createDataFrame([("a",), ("b",)], "deck_id string")
    assert sorted((r.deck_id, r.n) for r in sinks.replace_rows(old, new, rebuilt).collect()) == [("a", 2), ("c", 1)]


def test_partition_overwrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("bucket"))
    sinks.overwrite_touched(base, path, ["bucket"])
    change = base.where("bucket = 1").withColumn("id", F.col("id") + 1000)
    for _ in range(2):
        sinks.overwrite_touched(change, path, ["bucket"])
    got = spark.read.parquet(path)
    assert got.count() == 40 and got.where("id >= 1000").count() == 10


def test_appends_do_not_duplicate(spark):
    new = spark.createDataFrame([("v", 1.0, 2.0, "t", [0.1]), ("v", 1.0, 2.0, "t", [0.1]), ("v", 3.0, 4.0, "t", [0.1])], "video_id string, from_sec double, to_sec double, text string, embedding array<float>")
    old = new.where("from_sec = 3").drop("text")
    fresh = sinks.unseen_caption_segments(new, old)
    assert [r.from_sec for r in fresh.collect()] == [1.0] and "text" not in fresh.columns
    assert sinks.unseen_caption_segments(new, old.unionByName(fresh)).count() == 0


def test_artifacts_never_show_the_video(spark, tmp_path):
    rows = spark.createDataFrame([("01-keyframes", "V01", "abcdefghijk", "/tmp/x/abcdefghijk/f.jpeg", "failed for abcdefghijk")], "stage string, label string, video_id string, path string, message string")
    sinks.write_artifacts(rows, str(tmp_path / "a"))
    r = spark.read.json(str(tmp_path / "a")).first()
    assert (r.file_name, r.message, r.label, r.stage) == ("f.jpeg", "failed for V01", "V01", "01-keyframes")


def test_report_tables(spark, tmp_path):
    t = spark.createDataFrame([("r", 1)], "report string, n int")
    sinks.write_report(t, t, t, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "gates_json")).count() == 1 and spark.read.parquet(str(tmp_path / "r" / "runs")).count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"manifest_id": "m", "schema_version": "1.0", "summary": {"total": 1}, "figures": [{"figure_id": "f", "extra": 1}]}))
    (tmp_path / "bad.json").write_text("{")
    good, bad = readers.parse_manifests(readers.read_json_text(spark, str(tmp_path)))
    assert [r.manifest_id for r in good.collect()] == ["m"] and [r.stage for r in bad.collect()] == ["manifest_parse"]
    with pytest.raises(ValueError):
        readers.sample_set(spark.createDataFrame([("V01", "a"), ("V01", "b")], "index string, video_id string"))
    outlines = spark.createDataFrame([('{"video_id": "12345678901"}',), ('{"video_id": "short"}',)], "raw string")
    good, bad = readers.parse_outlines(outlines)
    assert (good.count(), bad.count()) == (1, 1)


def test_captions_take_the_lowest_row_and_quarantine_the_unreadable(spark):
    seg = '[{"from_sec": 1, "to_sec": 2, "text": "a"}, {"from_sec": 2, "to_sec": 3, "text": "b"}]'
    rows = spark.createDataFrame([(2, 1, "[]"), (1, 1, seg), (3, 2, "[{")], "caption_id long, video_id long, segments string")
    videos = spark.createDataFrame([(1, "x"), (2, "y")], "id long, external_id string")
    good, bad = readers.load_captions(rows, videos)
    assert [(r.external_id, r.ord, r.text) for r in good.orderBy("ord").collect()] == [("x", 0, "a"), ("x", 1, "b")]
    assert [r.external_id for r in bad.collect()] == ["y"]


LOG = "job_id string, seq long, event_us long, event string, stage string, timeout_us long, attempt_count long, last_error string"


def test_job_state_columns_have_their_own_last_writer(spark):
    log = spark.createDataFrame(
        [("j", 1, 1, "create", None, None, None, None), ("j", 2, 2, "enter", "detect", 99, None, None), ("j", 3, 3, "fail", "select", None, 2, "boom"), ("j", 4, 4, "enter", "build", 50, None, None),
         ("k", 1, 1, "enter", "build", 9, None, None), ("k", 2, 2, "complete", None, None, 1, None)], LOG)
    got = {r.job_id: (r.stage, r.status, r.timeout_us, r.attempt_count, r.last_error, r.failure_stage) for r in jobs.job_state(log.union(log)).collect()}
    assert got == {"j": ("build", "running", 50, 2, "boom", "select"), "k": ("build", "done", None, 1, None, None)}
    swept = {r.job_id: (r.status, r.last_error, r.failure_stage, r.timed_out) for r in jobs.timeout_sweep(jobs.job_state(log), F.lit(60)).collect()}
    assert swept == {"j": ("error", "timeout", "build", True), "k": ("done", None, None, False)}


def test_stream_equals_batch_over_several_batches(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    log = job_events_of(events)
    parts = log.randomSplit([1.0, 1.0, 1.0], 5)
    source, store = str(tmp_path / "log"), Store(spark, str(tmp_path / "state"), 4)
    for part in [*parts, parts[0]]:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_job_state(stream, store, str(tmp_path / "progress"), True, "3650 days", 36500, compact_at=2).awaitTermination()
    want = jobs.job_state(log)
    got = read_job_state(store).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert sweep_job_state(store, F.lit(1 << 60)).where("status = 'running'").isEmpty()
    # Folders do not grow with the batches.
    assert all(len(f) <= 2 for f in store.record()["tables"]["jobs"]["buckets"].values())


def test_timeouts_come_by_timer_and_finished_jobs_leave_the_state(spark, tmp_path):
    day = 86_400_000_000
    base = 1_700_000_000_000_000
    batches = [
        [("slow", 1, base, "create", None, None, None, None), ("slow", 2, base, "enter", "detect", base + 1_500, None, None), ("done", 1, base, "enter", "build", base + day, None, None), ("done", 2, base + 1, "complete", None, None, 1, None)],
        [("tick", 1, base + 60_000_000, "create", None, None, None, None)],
        [("tick", 2, base + 3 * day, "enter", "detect", base + 9 * day, None, None), ("late", 1, base + 3 * day, "enter", "build", base + 9 * day, None, None)],
    ]
    source, store, seen = str(tmp_path / "log"), Store(spark, str(tmp_path / "state"), 4), []
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        query = start_job_state(stream, store, str(tmp_path / "progress"), True, "1 second", keep_days=1)
        query.awaitTermination()
        seen.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    log = spark.read.schema(LOG).parquet(source)
    clock = base + 3 * day - 1_000_000
    want = jobs.timeout_sweep(jobs.job_state(log), F.lit(clock))
    got = read_job_state(store).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    slow = got.where("job_id = 'slow'").first()
    assert (slow.status, slow.last_error, slow.failure_stage, slow.timed_out) == ("error", "timeout", "detect", True)
    # The two finished jobs are out of the state, the table still has them.
    assert seen[-1] <= seen[0] and got.count() == 4


def test_deck_audit(spark):
    inch = 914400
    def shape(slide, no, text, y=1.0, cy=1.0, x=0.0, cx=1.0, **flags):
        return ("d", slide, no, int(x * inch), int(y * inch), int(cx * inch), int(cy * inch), text, flags.get("dark", False), flags.get("img", False), flags.get("tbl", False))

    rows = [shape(1, 1, "cover"), shape(2, 1, "x" * 50), shape(3, 1, "y" * 200, y=1.0, cy=2.0), shape(4, 1, "z" * 50, img=True), shape(5, 1, "“q”"),
            shape(6, 1, "이"), shape(6, 2, "영상 " + "w" * 200, y=5.0), shape(7, 1, "a" * 200, x=13.0, cx=2.0, y=5.0), shape(8, 1, "end")]
    df = spark.createDataFrame(rows, "deck_id string, slide_no int, shape_no long, x long, y long, cx long, cy long, text string, dark boolean, has_img boolean, has_tbl boolean")
    a = {r.slide_no: (r.density, r.meta_hit, r.n_overflow) for r in audits.audit_slides(audits.slide_facts(df)).collect()}
    assert a == {1: (None, None, 0), 2: ("sparse", None, 0), 3: ("empty_lower_half", None, 0), 4: (None, None, 0), 5: (None, None, 0), 6: (None, "이 영상", 0), 7: (None, None, 1), 8: (None, None, 0)}
    strict = audits.deck_verdicts(audits.audit_slides(audits.slide_facts(df)), 8).first()
    assert (strict.hard_problems, strict.passes) == (4, False)
    names = ["ppt/media/image1.png", "ppt/media/image1.png", "ppt/media/image2.JPEG", "ppt/media/film.mp4", "ppt/charts/chart1.xml", "ppt/charts/style1.xml", "x/ppt/media/a.png"]
    files = spark.createDataFrame([("d", n) for n in names], "deck_id string, name string")
    audited = audits.audit_slides(audits.slide_facts(df))
    lenient = {k: audits.deck_verdicts(audited, 12, True, k, files).first() for k in (2, 3)}
    assert (lenient[2].hard_problems, lenient[2].images, lenient[3].hard_problems) == (3, 2, 4)
    assert audits.deck_verdicts(audited, 12, True, 1).first().hard_problems == 4
    stats = audits.text_stats(audits.slide_facts(df), files).first()
    assert (stats.n_media, stats.n_charts, stats.table_slides) == (3, 1, 0)


def test_transcript_pages_join_to_the_whole(spark):
    df = spark.createDataFrame([("b", i, "" if i == 3 else f"t{i}") for i in range(10)], "collection_id string, ord long, text string")
    pages = [r.transcript for r in decks.transcripts(df, 4).orderBy("page").collect()]
    assert len(pages) == 3 and "\n\n".join(pages) == "\n\n".join(f"t{i}" for i in range(10) if i != 3)


def test_exact_quantile(spark):
    import numpy as np

    values = [float(v) for v in np.random.default_rng(1).integers(0, 500, 301)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = jobs.exact_quantile(df, ["g"], "v", 0.95, F.floor(F.col("v") / 7), "p").first().p
    assert got == pytest.approx(float(np.quantile(values, 0.95)))


def test_unreadable_box_replies_are_quarantined(spark):
    rows = [(1, '{"image": {"w": 9, "h": 9}, "boxes": [{"bbox": {"x": 1, "y": 1, "w": 2, "h": 2}, "cls": "table", "score": 0.5}]}'), (2, '{"boxes": ['), (3, None)]
    good, bad = readers.ingest_boxes(spark.createDataFrame(rows, "frame_id long, raw string"))
    assert [r.frame_id for r in good.collect()] == [1] and {r.frame_id for r in bad.collect()} == {2, 3}


def test_merged_sketches_stay_within_their_error(spark):
    import numpy as np

    values = np.random.default_rng(3).lognormal(size=20_000)
    df = spark.createDataFrame([("g", i % 50, float(v)) for i, v in enumerate(values)] + [("none", 0, None)], "g string, day int, v double")
    daily = jobs.quantile_sketches(df, ["g", "day"], "v")
    for q in (0.05, 0.5, 0.95):
        got = {r.g: r for r in jobs.sketched_quantile(daily, ["g"], q, "p").collect()}
        assert abs((values <= got["g"].p).mean() - q) <= jobs.RANK_ERROR and got["g"].n_values == 20_000
        assert got["none"].p is None and got["none"].n_values == 0


def _summary(**changes):
    doc = {
        "video_id": "12345678901", "template_version": "v2", "quality_flag": "pass", "transcript_used": True,
        "core": {c: "x" for c in ("one_liner", "domain", "depth_level", "content_type", "target_audience")}, "analysis": {"entities": None, "more": [1]},
        "segments": {"sections": [{"from_sec": 0, "to_sec": 9.5, "title": "a", "relevance_pct": 50, "key_points": [{"text": "k"}]}], "atoms": [{"type": "fact", "text": "t"}]},
    }
    return json.dumps({**doc, **changes})


def test_summaries_name_the_first_bad_path(spark):
    cases = [
        (_summary(), None), (_summary(segments=None), None), (_summary(segments={}), None), ("{", "$"), (None, "$"), ("[]", "$"),
        (_summary(video_id="short"), "$.video_id"), (_summary(video_id=12345678901), "$.video_id"), (_summary(template_version="v1", core=3), "$.template_version"),
        (_summary(transcript_used=False), "$.transcript_used"), (_summary(analysis=None), "$.analysis"), (_summary(analysis={"core_argument": None}), "$.analysis.core_argument"),
        (_summary(core={"one_liner": "x"}), "$.core.domain"), (_summary(segments=[]), "$.segments"), (_summary(segments={"sections": {}}), "$.segments.sections"),
        (_summary(segments={"sections": [{"from_sec": 0, "to_sec": 1, "title": "a", "relevance_pct": 1}, {"from_sec": "0"}]}), "$.segments.sections[1].from_sec"),
        (_summary(segments={"atoms": [{"type": "fact", "text": "t", "entity_refs": ["a", 2]}]}), "$.segments.atoms[0].entity_refs[1]"),
    ]
    good, bad = readers.parse_summaries(spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string"))
    assert {r.i: r.bad_path for r in bad.collect()} == {i: p for i, (_, p) in enumerate(cases) if p}
    assert good.count() == 3 and [(r["index"], r.to_sec) for r in readers.summary_sections(good).collect()] == [(0, 9.5)]


def test_a_job_costs_three_calls_to_the_state():
    from cuesheet.streaming.jobs import JobStates

    calls, held = [], {}

    class Kept:
        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, value):
            calls.append("update")
            held["v"] = value

    class Handle:
        def getValueState(self, name, schema):
            return Kept()

        def registerTimer(self, ms):
            calls.append(ms)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    states = JobStates("acquire", 1000)
    states.init(Handle())
    row = {"seq": 1, "event_us": 5000, "event": "enter", "stage": "build", "timeout_us": 9000, "attempt_count": None, "last_error": None}
    first = list(states.handleInputRows(("j",), iter([row]), Times()))
    assert calls == ["get", 10, "update"] and first[0].status == "running"
    # The same row again changes nothing, so nothing is written.
    assert list(states.handleInputRows(("j",), iter([row]), Times())) == first and calls[3:] == ["get"]


class _Handle:
    """State and timers of one key, and the calls made to them."""

    def __init__(self):
        self.calls, self.held, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.calls.append("clear")
        self.held = None

    def registerTimer(self, ms):
        self.calls.append(ms)
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls.append(-ms)
        self.timers.remove(ms)


class _Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def _log_row(*cells):
    """A row as it comes to a group."""
    return Row(_group=3, event_time=None, _entry=json.dumps([c if c is None else str(c) for c in cells]))


def _group(handle, groups=8, keep_ms=1000):
    from cuesheet.streaming.jobs import JobGroups

    states = JobGroups("acquire", keep_ms, groups)
    states.init(handle)
    return states


def test_a_group_of_jobs_costs_the_calls_of_one():
    handle = _Handle()
    states = _group(handle)
    rows = [_log_row(f"j{i}", 1, 5000, "enter", "build", 9000 + 1000 * i, None, None) for i in range(50)]
    rows += [_log_row(None, 1, 5000, "create", None, None, None, None), _log_row("None", 1, 5000, "fail", "build", None, 2, "e")]
    first = list(states.handleInputRows((3,), iter(rows), _Times(0)))
    assert handle.calls == ["get", 10, "update"] and len(first) == 52
    assert {r.job_id: r.status for r in first[-2:]} == {None: "queued", "None": "error"}
    # The same rows again change nothing, so nothing is written.
    assert list(states.handleInputRows((3,), iter(rows), _Times(0))) == first and handle.calls[3:] == ["get"]
    # Jobs up to j3 are late at 13 ms and have no event; the next timer is that of j4.
    handle.calls.clear()
    late = list(states.handleExpiredTimer((3,), _Times(13), _Times(10)))
    assert [(r.job_id, r.last_error, r.timed_out) for r in late] == [(f"j{i}", "timeout", True) for i in range(4)]
    assert handle.calls == ["get", 14, "update"]
    # An earlier deadline takes the place of the timer.
    handle.timers = {14}
    list(states.handleInputRows((3,), iter([_log_row("k", 2, 6000, "enter", "build", 12_999, None, None)]), _Times(12)))
    assert handle.timers == {13}
    # Finished jobs leave after their time, those that are late now at the next timer, which is not the one the
    # engine is about to delete; a job without a timer stays.
    assert len(list(states.handleExpiredTimer((3,), _Times(10**6), _Times(1005)))) == 47 and handle.calls[-2:] == [1006, "update"]
    assert list(states.handleExpiredTimer((3,), _Times(10**6), _Times(1006))) == [] and list(states._known()[0]) == [None]
    # Also where the time to leave is the deadline.
    list(states.handleInputRows((3,), iter([_log_row("k", 1, 2_000_000, "enter", "build", 2_999_000, None, None)]), _Times(0)))
    assert [r.job_id for r in states.handleExpiredTimer((3,), _Times(3000), _Times(3000))] == ["k"]
    assert list(states.handleExpiredTimer((3,), _Times(3001), _Times(3001))) == [] and list(states._known()[0]) == [None]
    with pytest.raises(ValueError):
        _group(handle, groups=9)._known()


def test_rows_of_a_hot_job_are_cut_as_they_come(spark, monkeypatch):
    from cuesheet.streaming import jobs as streaming

    kinds = ["create", "enter", "fail", "enter", "complete", "enter"]
    rows = [("hot", i, (i * 7919) % 3000, kinds[i % 6], f"s{i % 5}", i, i if i % 4 == 0 else None, f"e{i}") for i in range(3000)]
    handle, longest = _Handle(), []
    states = _group(handle)
    winners = states._winners
    monkeypatch.setattr(states, "_winners", lambda r: longest.append(len(r)) or winners(r))
    got = list(states.handleInputRows((3,), (_log_row(*r) for r in rows), _Times(-(10**15))))
    assert max(longest) <= streaming._PENDING + 7
    want = jobs.job_state(spark.createDataFrame(rows, LOG)).first().asDict()
    assert [{k: r[k] for k in want} for r in got] == [want]


def test_groups_and_single_jobs_keep_the_same_states(spark, tmp_path):
    rng = random.Random(4)
    base, hour = 1_700_000_000_000_000, 3_600_000_000
    parts = [[(None, 1, base, "create", None, None, None, None), ("null", 1, base, "fail", "", None, 1 << 62, "null"), ("n", None, base, "enter", None, None, None, None)], [], []]
    for i in range(900):
        us = base + (i // 300) * 30 * hour + rng.randrange(hour)
        event = rng.choice(["create", "enter", "enter", "complete", "fail"])
        due = us + rng.randrange(1, 40) * hour if event == "enter" else None
        error = rng.choice([None, "", 'a "b"\\\n', "오류 ☠"]) if event == "fail" else None
        parts[i // 300].append((f"j{rng.randrange(200)}", i, us, event, rng.choice("abc"), due, rng.choice([None, 1, 2]), error))
    got, state = {}, {}
    for groups in (3, None):
        source, store = str(tmp_path / f"log{groups}"), Store(spark, str(tmp_path / f"state{groups}"), 4)
        for part in parts:
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(LOG).parquet(source)
            query = start_job_state(stream, store, str(tmp_path / f"progress{groups}"), True, "0 seconds", 1, groups=groups)
            query.awaitTermination()
        got[groups] = sorted(map(str, read_job_state(store).drop("batch").collect()))
        state[groups] = query.recentProgress[0]["stateOperators"][0]
    assert got[3] == got[None] and any("timed_out=True" in r for r in got[3]) and any("status='running'" in r for r in got[3])
    # Keys and timers, at most two a group in a batch, are not as many as jobs.
    assert state[3]["numRowsTotal"] == 3 and state[3]["customMetrics"]["numRegisteredTimers"] <= 6 < state[None]["customMetrics"]["numRegisteredTimers"]
