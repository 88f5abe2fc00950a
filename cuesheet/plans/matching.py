"""Queries that match frames, figures and sections in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import joins
from cuesheet.operators.generators import request_windows
from cuesheet.plans.bindings import ctes, frames, sections, slides, topic_points
from cuesheet.plans.frames import DAY, REQUEST_HALF, REQUESTS, requests
from cuesheet.plans.registry import query


@query(
    "j2_best_overlap",
    ctes(
        "frames sections",
        """, paired AS (
  SELECT f.video_id, f.ord, s.index AS overlap_section,
         least(f.t_end, s.to_sec) - greatest(f.t_start, s.from_sec) AS overlap_sec
  FROM frames f LEFT JOIN sections s ON s.video_id = f.video_id
    AND least(f.t_end, s.to_sec) - greatest(f.t_start, s.from_sec) >= 0)
SELECT video_id, ord, overlap_section, round(overlap_sec, 6) AS overlap_sec
FROM paired QUALIFY row_number() OVER (
  PARTITION BY video_id, ord ORDER BY overlap_sec DESC NULLS LAST, overlap_section) = 1""",
    ),
)
def j2(spark, folder):
    return joins.best_overlap(frames(spark, folder), sections(spark, folder), DAY).select(
        "video_id", "ord", "overlap_section", F.round("overlap_sec", 6).alias("overlap_sec")
    )


# Sections with gaps: only the first half of every tenth.
_GAPPED = """, gapped AS (SELECT video_id, index, from_sec, (from_sec + to_sec) / 2 AS to_sec FROM sections)"""


def _gapped(spark, folder):
    return sections(spark, folder).select(
        "video_id", "index", "from_sec", ((F.col("from_sec") + F.col("to_sec")) / 2).alias("to_sec")
    )


@query(
    "j3_containing_section",
    ctes(
        "frames sections",
        _GAPPED
        + """, found AS (SELECT f.video_id, f.ord, min(s.index) AS hit FROM frames f LEFT JOIN gapped s
  ON s.video_id = f.video_id AND f.timestamp_sec >= s.from_sec AND f.timestamp_sec < s.to_sec GROUP BY f.video_id, f.ord)
SELECT video_id, ord, coalesce(hit, 0) AS in_section, hit IS NOT NULL AS section_matched FROM found""",
    ),
)
def j3(spark, folder):
    return joins.containing_section(frames(spark, folder), _gapped(spark, folder), 0, DAY).select(
        "video_id", "ord", "in_section", "section_matched"
    )


@query(
    "j4_topic_alignment",
    ctes(
        "slides topic_points",
        """, found AS (SELECT f.video_id, f.ord, min(p.ord) AS topic_ord FROM frames f LEFT JOIN topic_points p
  ON p.video_id = f.video_id AND abs(f.timestamp_sec - p.timestamp_sec) <= 3600 GROUP BY f.video_id, f.ord)
SELECT f.video_id, f.ord, f.topic_ord, round(p.timestamp_sec, 6) AS topic_sec, f.topic_ord IS NOT NULL AS is_topic_aligned
FROM found f LEFT JOIN topic_points p ON p.video_id = f.video_id AND p.ord = f.topic_ord""",
    ),
)
def j4(spark, folder):
    return joins.topic_alignment(frames(spark, folder), topic_points(spark, folder), 3600.0).select(
        "video_id", "ord", "topic_ord", F.round("topic_sec", 6).alias("topic_sec"), "is_topic_aligned"
    )


@query(
    "j5_nearest_frame",
    ctes(
        "slides",
        """, figures AS (SELECT video_id, ord, timestamp_sec FROM slides WHERE event_type = 'error'),
selected AS (SELECT video_id, ord AS snapshot, timestamp_sec AS frame_sec FROM slides WHERE is_slide)
SELECT f.video_id, f.ord, s.snapshot FROM figures f LEFT JOIN selected s ON s.video_id = f.video_id
QUALIFY row_number() OVER (PARTITION BY f.video_id, f.ord ORDER BY abs(s.frame_sec - f.timestamp_sec), s.snapshot) = 1""",
    ),
)
def j5(spark, folder):
    all_frames = slides(spark, folder)
    figures = all_frames.where("event_type = 'error'").select("video_id", "ord", "timestamp_sec")
    selected = all_frames.where("is_slide").select(
        "video_id", F.col("ord").alias("snapshot"), F.col("timestamp_sec").alias("frame_sec")
    )
    return joins.nearest(figures, selected, "frame_sec", "snapshot", "snapshot", width=3600.0).select(
        "video_id", "ord", "snapshot"
    )


@query(
    "j6_frames_in_windows",
    ctes(
        "frames",
        REQUESTS
        + """ SELECT video_id, ord, quality_score FROM frames f WHERE EXISTS (
               SELECT 1 FROM windows w WHERE w.video_id = f.video_id AND f.timestamp_sec BETWEEN w.lo AND w.hi)""",
    ),
)
def j6(spark, folder):
    windows = request_windows(requests(spark, folder), REQUEST_HALF)
    return joins.frames_in_windows(frames(spark, folder), windows, REQUEST_HALF).select(
        "video_id", "ord", "quality_score"
    )


@query(
    "j8_midpoint_sections",
    ctes(
        "frames sections",
        _GAPPED
        + """, paired AS (SELECT f.video_id, f.ord, min(s.index) AS index FROM frames f LEFT JOIN gapped s
  ON s.video_id = f.video_id AND (f.t_start + f.t_end) / 2 BETWEEN s.from_sec AND s.to_sec GROUP BY f.video_id, f.ord)
SELECT video_id, ord, index, CASE WHEN index IS NULL THEN 'data_only' ELSE 'paired' END AS pairing FROM paired
UNION ALL
SELECT video_id, NULL, index, 'text_only' FROM gapped g WHERE NOT EXISTS (
  SELECT 1 FROM paired p WHERE p.video_id = g.video_id AND p.index = g.index)""",
    ),
)
def j8(spark, folder):
    return joins.midpoint_sections(frames(spark, folder), _gapped(spark, folder), DAY)


_STATUS = "CASE phash % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'dropped' END"


def _with_status(frame):
    k = F.col("phash") % 3
    return frame.withColumn(
        "manifest_status", F.when(k == 0, "verified").when(k == 1, "unverified").otherwise("dropped")
    )


@query(
    "j9_attach_figures",
    ctes(
        "frames sections",
        _GAPPED
        + f""", live AS (SELECT video_id, ord, timestamp_sec FROM frames WHERE {_STATUS} <> 'dropped'),
found AS (SELECT f.video_id, f.ord, any_value(f.timestamp_sec) AS t, min(s.index) AS hit FROM live f LEFT JOIN gapped s
  ON s.video_id = f.video_id AND f.timestamp_sec >= s.from_sec AND f.timestamp_sec < s.to_sec GROUP BY f.video_id, f.ord)
SELECT video_id, ord, hit AS in_section, 'window' AS attached_by FROM found WHERE hit IS NOT NULL
UNION ALL
SELECT * FROM (SELECT f.video_id, f.ord, s.index, 'nearest' FROM found f LEFT JOIN gapped s ON s.video_id = f.video_id
  WHERE f.hit IS NULL QUALIFY row_number() OVER (PARTITION BY f.video_id, f.ord ORDER BY abs(s.from_sec - f.t), s.index) = 1)""",
    ),
)
def j9(spark, folder):
    figures = _with_status(frames(spark, folder)).select("video_id", "ord", "timestamp_sec", "manifest_status")
    return joins.attach_figures(figures, _gapped(spark, folder), DAY).select(
        "video_id", "ord", "in_section", "attached_by"
    )


@query(
    "j14_text_with_figures",
    ctes(
        "frames sections",
        """, figures AS (SELECT video_id, ord, timestamp_sec FROM frames WHERE event_type = 'error')
SELECT s.video_id, s.index, s.title, count(f.ord) AS n_figures, min(f.ord) AS first_figure, max(f.ord) AS last_figure
FROM sections s LEFT JOIN figures f ON f.video_id = s.video_id AND f.timestamp_sec >= s.from_sec AND f.timestamp_sec < s.to_sec
GROUP BY s.video_id, s.index, s.title""",
    ),
)
def j14(spark, folder):
    figures = frames(spark, folder).where("event_type = 'error'")
    return joins.text_with_figures(sections(spark, folder), figures, DAY).groupBy(
        "video_id", "index", "title"
    ).agg(
        F.count("figure_ord").alias("n_figures"),
        F.min("figure_ord").alias("first_figure"),
        F.max("figure_ord").alias("last_figure"),
    )
