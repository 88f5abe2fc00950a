"""Caption queries: topic boundaries, membership flags, sinks without text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions.timeline import cosine_distance
from cuesheet.operators.joins import flag_boundaries
from cuesheet.operators.windows import long_segments, topic_boundaries
from cuesheet.ordering import ord_slot
from cuesheet.plans.bindings import captions, ctes
from cuesheet.plans.registry import query

# Segments of a label are thinly spread over the ids, so slots are narrow here.
def _slot():
    return ord_slot("ord", 4096)


@query(
    "p2_long_segments",
    ctes("captions", "SELECT video_id, ord, from_sec, to_sec FROM captions WHERE to_sec - from_sec >= 5"),
)
def p2(spark, folder):
    return long_segments(captions(spark, folder)).select("video_id", "ord", "from_sec", "to_sec")


_BOUNDARIES = """, kept AS (SELECT * FROM captions WHERE to_sec - from_sec >= 5.0),
paired AS (SELECT *, lag(embedding) OVER (PARTITION BY video_id ORDER BY ord) AS prev FROM kept),
boundaries AS (
  SELECT video_id, ord, from_sec AS timestamp_sec,
         CASE WHEN text <> '' THEN left(text, 60) END AS topic_label,
         round(1 - list_cosine_similarity(prev::DOUBLE[], embedding::DOUBLE[]), 6) AS distance
  FROM paired
  WHERE prev IS NOT NULL AND 1 - list_cosine_similarity(prev::DOUBLE[], embedding::DOUBLE[]) > 0.3)
"""


@query("w1_topic_boundaries", ctes("captions", _BOUNDARIES + "SELECT * FROM boundaries"))
def w1(spark, folder):
    return topic_boundaries(captions(spark, folder), slot=_slot()).withColumn(
        "distance", F.round("distance", 6)
    )


@query(
    "f1_cosine_distance",
    ctes(
        "captions",
        """SELECT a.ord AS a_ord, b.ord AS b_ord,
             round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
           FROM captions a JOIN captions b ON b.ord = a.ord + 1""",
    ),
)
def f1(spark, folder):
    a = captions(spark, folder).select(F.col("ord").alias("a_ord"), F.col("embedding").alias("a"), (F.col("ord") + 1).alias("b_ord"))
    b = captions(spark, folder).select(F.col("ord").alias("b_ord"), F.col("embedding").alias("b"))
    return a.join(b, "b_ord").select(
        "a_ord", "b_ord", F.round(cosine_distance(F.col("a"), F.col("b")), 6).alias("distance")
    )


@query(
    "j15_boundary_membership",
    ctes(
        "captions",
        _BOUNDARIES
        + """SELECT c.video_id, c.ord, c.from_sec,
               EXISTS (SELECT 1 FROM boundaries b WHERE b.video_id = c.video_id AND b.timestamp_sec = c.from_sec) AS is_topic_boundary
             FROM captions c""",
    ),
)
def j15(spark, folder):
    segments = captions(spark, folder)
    return flag_boundaries(segments, topic_boundaries(segments, slot=_slot())).select(
        "video_id", "ord", "from_sec", "is_topic_boundary"
    )
