"""Frame queries: sampling, near-duplicate runs, even cuts, repair, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import timeline
from cuesheet.operators import generators, ranking, windows
from cuesheet.operators.joins import best_overlap
from cuesheet.ordering import position, previous, time_slot
from cuesheet.plans.bindings import (
    RADIUS,
    SLOT_SEC,
    TARGET,
    ctes,
    events,
    frames,
    recordings,
    sections,
    slides,
    loose_frames,
)
from cuesheet.plans.registry import query

DAY = 86400.0


def _numbered(spark, folder, source=frames):
    return position(
        source(spark, folder),
        ["video_id"],
        [F.col("timestamp_sec"), F.col("ord")],
        time_slot("timestamp_sec", SLOT_SEC),
        "pos",
        "n",
    )


# --- runs, cut, repair ----------------------------------------------------------------------

_RUNS = f""", placed AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, ord) - 1 AS pos FROM frames),
walk AS (
  SELECT video_id, pos, phash AS rep, 0::BIGINT AS run_no FROM placed WHERE pos = 0
  UNION ALL
  SELECT p.video_id, p.pos,
         CASE WHEN bit_count(xor(w.rep, p.phash)) > {RADIUS} THEN p.phash ELSE w.rep END,
         CASE WHEN bit_count(xor(w.rep, p.phash)) > {RADIUS} THEN w.run_no + 1 ELSE w.run_no END
  FROM walk w JOIN placed p ON p.video_id = w.video_id AND p.pos = w.pos + 1),
runs AS (SELECT p.*, w.run_no FROM placed p JOIN walk w ON p.video_id = w.video_id AND p.pos = w.pos)"""

_MERGED = (
    _RUNS
    + """, spans AS (
  SELECT video_id, run_no, min(t_start) AS t_start, max(t_end) AS t_end,
         bool_or(is_scene_boundary) AS is_scene_boundary, count(*) AS run_size
  FROM runs GROUP BY video_id, run_no),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (
    PARTITION BY video_id, run_no ORDER BY quality_score DESC, timestamp_sec, ord) = 1),
merged AS (
  SELECT b.video_id, b.ord, b.timestamp_sec, b.section_index, b.quality_score, s.is_scene_boundary,
         s.t_start, s.t_end, s.run_size
  FROM best b JOIN spans s ON b.video_id = s.video_id AND b.run_no = s.run_no)"""
)


def _cut(source: str) -> str:
    return f""", counted AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, ord) - 1 AS i,
         count(*) OVER (PARTITION BY video_id) AS n FROM {source}),
bucketed AS (
  SELECT * EXCLUDE (i, n),
         CASE WHEN n <= {TARGET} THEN i ELSE ((i + 1) * {TARGET} - 1) // n END AS bucket FROM counted),
kept AS (
  SELECT * FROM bucketed QUALIFY row_number() OVER (
    PARTITION BY video_id, bucket ORDER BY quality_score DESC, timestamp_sec, ord) = 1)"""


_REPAIR = """, lost AS (
  SELECT * FROM merged m WHERE NOT EXISTS (
    SELECT 1 FROM kept k WHERE k.video_id = m.video_id AND k.section_index = m.section_index)),
repaired AS (
  SELECT * FROM lost QUALIFY row_number() OVER (
    PARTITION BY video_id, section_index ORDER BY quality_score DESC, timestamp_sec, ord) = 1)"""

_COLUMNS = (
    "video_id, ord, timestamp_sec, section_index, quality_score, is_scene_boundary, t_start, t_end, run_size"
)
_DOWNSAMPLED = (
    _MERGED
    + _cut("merged")
    + _REPAIR
    + f""", downsampled AS (
  SELECT {_COLUMNS}, false AS repaired FROM kept UNION ALL
  SELECT {_COLUMNS}, true AS repaired FROM repaired)"""
)


def _runs(spark, folder):
    return windows.near_duplicate_runs(frames(spark, folder), RADIUS, SLOT_SEC)


def _downsampled(spark, folder):
    return windows.downsample(frames(spark, folder), TARGET, RADIUS, SLOT_SEC)


def _merged(spark, folder):
    return windows.collapse_runs(_runs(spark, folder))


@query(
    "w2_near_duplicate_runs",
    ctes("frames", _RUNS + " SELECT video_id, ord, phash, run_no FROM runs", recursive=True),
)
def w2(spark, folder):
    return _runs(spark, folder).select("video_id", "ord", "phash", "run_no")


# All events as three recordings, long ones, walked in pieces. The walk of each is one list folded in SQL.
@query(
    "w2_runs_of_long_recordings",
    """WITH RECURSIVE frames AS MATERIALIZED (SELECT user_id % 3 AS video_id, event_id AS ord, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS phash,
    row_number() OVER (PARTITION BY user_id % 3 ORDER BY epoch_us(ts), event_id) AS i FROM events),
walk AS (SELECT video_id, ord, i, phash, phash AS first, CAST(0 AS BIGINT) AS run_no FROM frames WHERE i = 1
  UNION ALL SELECT f.video_id, f.ord, f.i, f.phash, CASE WHEN bit_count(xor(w.first, f.phash)) > 2 THEN f.phash ELSE w.first END,
    w.run_no + CASE WHEN bit_count(xor(w.first, f.phash)) > 2 THEN 1 ELSE 0 END FROM walk w JOIN frames f ON f.video_id = w.video_id AND f.i = w.i + 1)
SELECT video_id, ord, run_no, max(run_no) OVER (PARTITION BY video_id) + 1 AS n_runs FROM walk""",
)
def w2_long(spark, folder):
    t = events(spark, folder)
    start = F.lit(t.agg(F.min("us")).first()[0])
    rows = t.select(
        (F.col("user_id") % 3).alias("video_id"), F.col("event_id").alias("ord"), ((F.col("us") - start) / F.lit(1e6)).alias("timestamp_sec"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("phash"),
    )
    runs = windows.near_duplicate_runs(rows, RADIUS, SLOT_SEC, piece_rows=100)
    return runs.select("video_id", "ord", "run_no", "n_runs")


@query("a1_collapse_runs", ctes("frames", _MERGED + " SELECT * FROM merged", recursive=True))
def a1(spark, folder):
    return _merged(spark, folder).select(*_COLUMNS.split(", "))


@query(
    "w3_time_even_cut",
    ctes("frames", _cut("frames") + " SELECT video_id, ord, bucket, quality_score FROM kept"),
)
def w3(spark, folder):
    parts = windows.even_cut_buckets(frames(spark, folder), TARGET, SLOT_SEC)
    return windows._sharpest(parts, ["video_id", "bucket"]).select(
        "video_id", "ord", "bucket", "quality_score"
    )


@query(
    "w4_coverage_repair",
    ctes(
        "frames",
        _MERGED + _cut("merged") + _REPAIR + " SELECT video_id, section_index, ord, quality_score FROM repaired",
        recursive=True,
    ),
)
def w4(spark, folder):
    return _downsampled(spark, folder).where("repaired").select(
        "video_id", "section_index", "ord", "quality_score"
    )


@query("w5_downsample", ctes("frames", _DOWNSAMPLED + " SELECT * FROM downsampled", recursive=True))
def w5(spark, folder):
    return _downsampled(spark, folder).select(
        *_COLUMNS.split(", "), "repaired"
    )


@query(
    "u2_kept_and_repaired",
    ctes(
        "frames",
        _DOWNSAMPLED
        + """ SELECT video_id, count(*) AS n_frames, count(*) FILTER (repaired) AS n_repaired,
                     count(DISTINCT section_index) AS n_sections FROM downsampled GROUP BY video_id""",
        recursive=True,
    ),
)
def u2(spark, folder):
    frame = _downsampled(spark, folder)
    return frame.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if("repaired").alias("n_repaired"),
        F.countDistinct("section_index").alias("n_sections"),
    )


@query(
    "w5_downsample_with_section",
    ctes(
        "frames sections",
        _DOWNSAMPLED
        + """, paired AS (
  SELECT d.*, s.index AS overlap_section,
         least(d.t_end, s.to_sec) - greatest(d.t_start, s.from_sec) AS overlap_sec
  FROM downsampled d LEFT JOIN sections s ON s.video_id = d.video_id
    AND least(d.t_end, s.to_sec) - greatest(d.t_start, s.from_sec) >= 0)
SELECT video_id, ord, timestamp_sec, t_start, t_end, run_size, repaired, overlap_section,
       round(overlap_sec, 6) AS overlap_sec
FROM paired QUALIFY row_number() OVER (
  PARTITION BY video_id, ord ORDER BY overlap_sec DESC NULLS LAST, overlap_section) = 1""",
        recursive=True,
    ),
)
def w5_with_section(spark, folder):
    kept = _downsampled(spark, folder)
    return best_overlap(kept, sections(spark, folder), DAY).select(
        "video_id", "ord", "timestamp_sec", "t_start", "t_end", "run_size", "repaired",
        "overlap_section", F.round("overlap_sec", 6).alias("overlap_sec"),
    )


# --- samples and fills ----------------------------------------------------------------------

# A scene lasts from one scene boundary to the next; the first starts with the recording.
_SCENES = """, cuts AS (
  SELECT video_id, ord, timestamp_sec, duration FROM frames WHERE is_scene_boundary),
scenes AS (
  SELECT video_id, ord, timestamp_sec AS start,
         least(timestamp_sec + 60 + ord % 400,
               coalesce(lead(timestamp_sec) OVER (PARTITION BY video_id ORDER BY timestamp_sec, ord), duration)) AS "end"
  FROM cuts),
shaped AS (
  SELECT *, CASE WHEN "end" - start <= 2.5 THEN 0
      ELSE least(floor(("end" - start) / 2.5), greatest(10, floor(("end" - start) / 20) + 1) - 1) END AS inner_n
  FROM scenes),
samples AS (
  SELECT video_id, ord, k AS sample,
         CASE WHEN k = 0 THEN start ELSE start + greatest("end" - start, 0) / (inner_n + 1) * k END AS timestamp_sec,
         start AS t_start, "end" AS t_end, k = 0 AS is_scene_boundary
  FROM shaped, unnest(range(0, CAST(inner_n AS BIGINT) + 1)) AS g(k)
  WHERE k = 0 OR start + greatest("end" - start, 0) / (inner_n + 1) * k < "end" - 0.5)"""

_FILLS = """, covered AS (
  SELECT DISTINCT s.video_id, CASE WHEN r.duration <= 0 THEN 0
      ELSE least(CAST(floor(s.timestamp_sec / r.duration * 10) AS INTEGER), 9) END AS section_index
  FROM samples s JOIN recordings r ON s.video_id = r.video_id),
missing AS (
  SELECT r.video_id, CAST(i AS INTEGER) AS section_index, r.duration
  FROM recordings r, unnest(range(0, 10)) AS g(i)
  WHERE r.duration > 0 AND NOT EXISTS (
    SELECT 1 FROM covered c WHERE c.video_id = r.video_id AND c.section_index = i)),
fills AS (
  SELECT video_id, (section_index / 10 * duration + (section_index + 1) / 10 * duration) / 2 AS timestamp_sec,
         section_index / 10 * duration AS t_start, (section_index + 1) / 10 * duration AS t_end,
         false AS is_scene_boundary
  FROM missing)"""


def _scenes(spark, folder):
    """Scenes of up to a few minutes, from one scene boundary of a recording to the next."""
    cuts = events(spark, folder).where("event_type = 'view'").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"), "us", (-F.col("us")).alias("_down"), (-F.col("event_id")).alias("_down_ord")
    )
    # The cut before, counted from the end, is the next one.
    cuts = previous(cuts, ["video_id"], ["_down", "_down_ord"], F.floor(F.col("_down") / (SLOT_SEC * 1e6)), {"_next": "us"})
    start, after = ((F.col(c) - F.col("first_us")) / F.lit(1e6) for c in ("us", "_next"))
    return cuts.join(recordings(spark, folder), "video_id").select(
        "video_id", "ord", start.alias("start"), F.least(start + 60 + F.col("ord") % 400, F.coalesce(after, "duration")).alias("end"), "duration"
    )


def _samples(spark, folder):
    return generators.scene_samples(_scenes(spark, folder))


@query(
    "g1_scene_samples",
    ctes(
        "frames",
        _SCENES
        + """ SELECT video_id, ord, sample, round(timestamp_sec, 3) AS timestamp_sec, round(t_end, 3) AS t_end,
                     is_scene_boundary FROM samples""",
    ),
)
def g1(spark, folder):
    return _samples(spark, folder).select(
        "video_id", "ord", "sample", F.round("timestamp_sec", 3).alias("timestamp_sec"),
        F.round("t_end", 3).alias("t_end"), "is_scene_boundary",
    )


@query(
    "u6_missing_deciles",
    ctes("frames", _SCENES + _FILLS + " SELECT video_id, section_index FROM missing"),
)
def u6(spark, folder):
    return generators.missing_deciles(_samples(spark, folder), recordings(spark, folder)).select(
        "video_id", "section_index"
    )


@query(
    "g2_decile_fills",
    ctes(
        "frames",
        _SCENES + _FILLS + """ SELECT video_id, round(timestamp_sec, 3) AS timestamp_sec, round(t_start, 3) AS t_start,
                                      round(t_end, 3) AS t_end FROM fills""",
    ),
)
def g2(spark, folder):
    missing = generators.missing_deciles(_samples(spark, folder), recordings(spark, folder))
    return generators.decile_fills(missing).select(
        "video_id", *[F.round(c, 3).alias(c) for c in ("timestamp_sec", "t_start", "t_end")]
    )


@query(
    "u1_candidate_pool",
    ctes(
        "frames",
        _SCENES
        + _FILLS
        + """, pool AS (SELECT video_id, timestamp_sec, is_scene_boundary FROM samples UNION ALL
                        SELECT video_id, timestamp_sec, is_scene_boundary FROM fills)
SELECT video_id, round(timestamp_sec, 3) AS timestamp_sec, is_scene_boundary FROM pool""",
    ),
)
def u1(spark, folder):
    pool = generators.candidates(_scenes(spark, folder), recordings(spark, folder))
    return pool.select("video_id", F.round("timestamp_sec", 3).alias("timestamp_sec"), "is_scene_boundary")


@query(
    "u5_forced_grabs",
    ctes(
        "frames",
        """, points AS (SELECT video_id, timestamp_sec FROM frames WHERE event_type = 'purchase')
SELECT video_id, count(*) AS n_grabs, count(*) FILTER (is_scene_boundary) AS n_boundaries
FROM (SELECT video_id, is_scene_boundary FROM frames UNION ALL SELECT video_id, false FROM points)
GROUP BY video_id""",
    ),
)
def u5(spark, folder):
    every = loose_frames(spark, folder)
    at = F.col("timestamp_sec")
    pool = every.select("video_id", at, at.alias("t_start"), (at + F.col("quality_score") * 10).alias("t_end"), "is_scene_boundary")
    points = every.where("event_type = 'purchase'")
    return (
        generators.with_forced_grabs(pool, points)
        .groupBy("video_id")
        .agg(F.count(F.lit(1)).alias("n_grabs"), F.count_if("is_scene_boundary").alias("n_boundaries"))
    )


@query(
    "g4_sample_grid",
    ctes(
        "sections",
        """SELECT video_id, index, CAST(k AS BIGINT) AS tick, round(from_sec + k / 0.001, 7) AS timestamp_sec
           FROM sections, unnest(range(0, CAST(ceil((to_sec - from_sec) * 0.001) AS BIGINT))) AS g(k)""",
    ),
)
def g4(spark, folder):
    # Sections last days here, so one sample per 1000 s instead of one per second.
    return generators.sample_grid(sections(spark, folder), 0.001).select(
        "video_id", "index", "tick", F.round("timestamp_sec", 7).alias("timestamp_sec")
    )


@query(
    "p16_duration_check",
    ctes(
        "recordings",
        """, checked AS (SELECT video_id, duration, CAST(n_frames AS DOUBLE) * 38000 AS expected FROM recordings)
SELECT video_id, duration, expected,
       CASE WHEN expected <= 0 THEN 'bad_expected' WHEN abs(duration - expected) / expected > 0.10 THEN 'duration_mismatch' END AS reject_reason
FROM checked""",
    ),
)
def p16(spark, folder):
    from cuesheet.operators.gates import duration_reason

    return recordings(spark, folder).select(
        "video_id", "duration", (F.col("n_frames").cast("double") * 38000).alias("expected")
    ).withColumn("reject_reason", duration_reason(F.col("duration"), F.col("expected")))


# --- scalars --------------------------------------------------------------------------------


@query(
    "f2_hamming",
    ctes(
        "frames",
        """SELECT a.video_id, a.ord, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS bits
           FROM frames a JOIN frames b ON a.ord + 1 = b.ord""",
    ),
)
def f2(spark, folder):
    a = frames(spark, folder).select("video_id", "ord", "phash", (F.col("ord") + 1).alias("next"))
    b = frames(spark, folder).select(F.col("ord").alias("next"), F.col("phash").alias("other"))
    return a.join(b, "next").select(
        "video_id", "ord", timeline.hamming(F.col("phash"), F.col("other")).alias("bits")
    )


@query("f3_decile", ctes("frames", "SELECT video_id, ord, section_index FROM frames"))
def f3(spark, folder):
    return frames(spark, folder).select("video_id", "ord", "section_index")


@query(
    "f4_keyframe_names",
    ctes(
        "frames",
        """, named AS (SELECT *, CAST(round_even(t_start, 0) AS BIGINT) AS s, CAST(round_even(t_end, 0) AS BIGINT) AS e,
             row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, ord) - 1 AS pos FROM frames)
SELECT video_id, ord, printf('keyframe_%04d_[%02dm%02ds-%02dm%02ds].jpeg', pos, s // 60, s % 60, e // 60, e % 60) AS file_name
FROM named""",
    ),
)
def f4(spark, folder):
    name = timeline.keyframe_name(F.col("pos"), F.col("t_start"), F.col("t_end"))
    return _numbered(spark, folder).select("video_id", "ord", name.alias("file_name"))


@query(
    "f5_figure_keys",
    ctes(
        "frames",
        """SELECT video_id, ord, substr(sha1('frame' || ord || ':' || CAST(floor(timestamp_sec) AS BIGINT) || ':-1'), 1, 16) AS figure_id
           FROM frames""",
    ),
)
def f5(spark, folder):
    stem = F.concat(F.lit("frame"), F.col("ord").cast("string"))
    return frames(spark, folder).select(
        "video_id", "ord", timeline.figure_key(stem, F.col("timestamp_sec"), F.lit(-1)).alias("figure_id")
    )


@query(
    "f9_caption_slice",
    ctes(
        "slides",
        """SELECT video_id, ord, printf('[%.1f, %.1f]', floor(t_start), floor(t_end)) ||
             CASE WHEN is_slide THEN ' ' || event_type ELSE '' END AS slice FROM slides""",
    ),
)
def f9(spark, folder):
    hint = F.when(F.col("is_slide"), F.col("event_type"))
    return slides(spark, folder).select(
        "video_id", "ord",
        timeline.caption_slice(F.floor("t_start").cast("double"), F.floor("t_end").cast("double"), hint).alias("slice"),
    )


@query(
    "f10_section_hint",
    ctes(
        "sections",
        """SELECT video_id, index, '[' || CAST(floor(from_sec) AS BIGINT) || '-' || CAST(floor(to_sec) AS BIGINT) || 's] ' || title ||
             CASE WHEN summary IS NULL THEN '' ELSE ': ' || summary END AS hint FROM sections""",
    ),
)
def f10(spark, folder):
    hint = timeline.section_hint(
        F.floor("from_sec").cast("double"), F.floor("to_sec").cast("double"), F.col("title"), F.col("summary")
    )
    return sections(spark, folder).select("video_id", "index", hint.alias("hint"))


# --- ranking --------------------------------------------------------------------------------

# Requested timestamps: the times at ranks 5 and n//2 of the recording itself.
REQUESTS = """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, ord) - 1 AS pos,
         count(*) OVER (PARTITION BY video_id) AS n FROM frames),
asked AS (
  SELECT video_id, pos, timestamp_sec AS asked_at FROM ranked WHERE pos = 5 OR pos = n // 2),
windows AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS request,
         greatest(0, asked_at - 40000) AS lo, asked_at + 40000 AS hi FROM asked)"""
REQUEST_HALF = 40000.0


def requests(spark, folder):
    """One row per recording with its requested timestamps."""
    asked = _numbered(spark, folder).where((F.col("pos") == 5) | (F.col("pos") == F.expr("n div 2")))
    times = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "timestamp_sec"))), lambda s: s["timestamp_sec"]
    )
    return asked.groupBy("video_id").agg(times.alias("timestamps"))


@query(
    "g3_request_windows",
    ctes("frames", REQUESTS + " SELECT video_id, request, round(lo, 6) AS lo, round(hi, 6) AS hi FROM windows"),
)
def g3(spark, folder):
    return generators.request_windows(requests(spark, folder), REQUEST_HALF).select(
        "video_id", "request", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")
    )


@query(
    "p17_frames_in_windows",
    ctes(
        "frames",
        REQUESTS
        + """ SELECT video_id, ord FROM frames f WHERE EXISTS (
               SELECT 1 FROM windows w WHERE w.video_id = f.video_id AND f.timestamp_sec BETWEEN w.lo AND w.hi)""",
    ),
)
def p17(spark, folder):
    joined = frames(spark, folder).join(requests(spark, folder), "video_id")
    return joined.where(
        generators.in_any_window(F.col("timestamp_sec"), F.col("timestamps"), REQUEST_HALF)
    ).select("video_id", "ord")


@query(
    "l1_request_frames",
    ctes(
        "frames",
        REQUESTS
        + """, hit AS (
  SELECT f.video_id, f.ord, f.timestamp_sec, f.phash % 5 AS fig_box_count FROM frames f WHERE EXISTS (
    SELECT 1 FROM windows w WHERE w.video_id = f.video_id AND f.timestamp_sec BETWEEN w.lo AND w.hi))
SELECT video_id, ord, fig_box_count, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY fig_box_count DESC, timestamp_sec, ord) AS INTEGER) AS rank FROM hit)
WHERE rank <= 4""",
    ),
)
def l1(spark, folder):
    from cuesheet.operators.joins import frames_in_windows

    inside = frames_in_windows(
        frames(spark, folder), generators.request_windows(requests(spark, folder), REQUEST_HALF), 40000.0
    ).withColumn("fig_box_count", F.col("phash") % 5)
    return ranking.request_frames(inside).select("video_id", "ord", "fig_box_count", "rank")


@query(
    "w7_cap_slides",
    ctes(
        "slides",
        """SELECT video_id, ord FROM slides WHERE is_slide
           QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, ord) <= 20""",
    ),
)
def w7(spark, folder):
    return windows.cap_per_recording(slides(spark, folder).where("is_slide")).select("video_id", "ord")


@query("p13_slides_only", ctes("slides", "SELECT video_id, ord FROM slides WHERE is_slide"))
def p13(spark, folder):
    return slides(spark, folder).where("is_slide").select("video_id", "ord")


@query(
    "l9_final_order",
    ctes(
        "frames",
        "SELECT video_id, ord, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, ord) - 1 AS pos FROM frames",
    ),
)
def l9(spark, folder):
    return _numbered(spark, folder).select("video_id", "ord", "pos").orderBy("video_id", "pos")


@query(
    "w8_section_figure_ids",
    ctes(
        "slides",
        """SELECT video_id, ord, video_id || '_' || printf('s%02d', section_index) || '_' || event_type || '_' ||
             printf('%03d', row_number() OVER (PARTITION BY video_id, section_index, event_type ORDER BY timestamp_sec, ord)) AS figure_id
           FROM slides""",
    ),
)
def w8(spark, folder):
    typed = slides(spark, folder).withColumnRenamed("event_type", "frame_type")
    return windows.section_figure_ids(typed, SLOT_SEC).select("video_id", "ord", "figure_id")


@query(
    "l3_review_picks",
    """WITH runs AS (SELECT event_type AS report, event_id AS idx,
          row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
       SELECT report, idx, pos FROM runs WHERE pos = 0 OR pos = n // 2""",
)
def l3(spark, folder):
    runs = events(spark, folder).select(F.col("event_type").alias("report"), F.col("event_id").alias("idx"))
    placed = position(runs, ["report"], [F.col("idx")], F.floor(F.col("idx") / 4096), "pos", "n")
    return ranking.review_picks(placed).select("report", "idx", "pos")
