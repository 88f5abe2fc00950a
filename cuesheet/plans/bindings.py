"""The given tables seen as recordings, frames, captions, boxes and runs.

Each binding exists twice: as a DataFrame for the plans and as a CTE for the SQL that checks
them. ``ctes`` puts the named CTEs, with what they need, in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions.timeline import decile
from cuesheet.ordering import position
from cuesheet.plans.registry import load

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def ctes(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named bindings, then ``body`` (which may go on with ``, x AS (...)``)."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"


# --- recordings: the event history of a user ------------------------------------------------

CTES["recordings"] = (
    (),
    """
    SELECT user_id AS video_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us,
           (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration, count(*) AS n_frames
    FROM events GROUP BY user_id""",
)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    return (
        events(spark, folder)
        .groupBy(F.col("user_id").alias("video_id"))
        .agg(
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.count(F.lit(1)).alias("n_frames"),
        )
        .withColumn("duration", (F.col("last_us") - F.col("first_us")) / F.lit(1e6))
    )


CTES["frames"] = (
    ("recordings",),
    """
    SELECT e.user_id AS video_id, e.event_id AS ord,
           (epoch_us(e.ts) - r.first_us) / 1e6 AS timestamp_sec, r.duration,
           CASE WHEN r.duration <= 0 THEN 0
                ELSE least(CAST(floor((epoch_us(e.ts) - r.first_us) / 1e6 / r.duration * 10) AS INTEGER), 9)
           END AS section_index,
           e.value AS quality_score, e.event_type, e.event_type = 'view' AS is_scene_boundary,
           (epoch_us(e.ts) - r.first_us) / 1e6 AS t_start,
           (epoch_us(e.ts) - r.first_us) / 1e6 + e.value * 10 AS t_end,
           CAST(regexp_extract(e.props, '[0-9]+') AS BIGINT) AS phash
    FROM events e JOIN recordings r ON e.user_id = r.video_id""",
)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame candidates: one per event, time counted from the user's first event."""
    t = (F.col("us") - F.col("first_us")) / F.lit(1e6)
    return (
        events(spark, folder)
        .withColumnRenamed("user_id", "video_id")
        .join(recordings(spark, folder), "video_id")
        .select(
            "video_id",
            F.col("event_id").alias("ord"),
            t.alias("timestamp_sec"),
            "duration",
            decile(t, F.col("duration")).alias("section_index"),
            F.col("value").alias("quality_score"),
            "event_type",
            (F.col("event_type") == "view").alias("is_scene_boundary"),
            t.alias("t_start"),
            (t + F.col("value") * 10).alias("t_end"),
            F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("phash"),
        )
    )


# Hashes hold 7 bits here, so runs use a radius of 2; recordings last 30 days, so time slots
# are an hour wide.
RADIUS = 2
SLOT_SEC = 3600.0
TARGET = 20

CTES["sections"] = (
    ("recordings",),
    """
    SELECT video_id, CAST(s.i AS INTEGER) AS index, greatest(0, s.i * duration / 10 - 3600) AS from_sec,
           (s.i + 1) * duration / 10 + 3600 AS to_sec, 'section ' || s.i AS title,
           CASE WHEN s.i % 2 = 0 THEN 'part ' || s.i || ' of recording ' || video_id END AS summary
    FROM recordings, unnest(range(0, 10)) AS s(i)""",
)


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """Ten sections per recording, each an hour longer at both ends so that they overlap."""
    i = F.col("index")
    return (
        recordings(spark, folder)
        .select("video_id", "duration", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("index"))
        .select(
            "video_id",
            "index",
            F.greatest(F.lit(0.0), i * F.col("duration") / 10 - 3600).alias("from_sec"),
            ((i + 1) * F.col("duration") / 10 + 3600).alias("to_sec"),
            F.concat(F.lit("section "), i.cast("string")).alias("title"),
            F.when(
                i % 2 == 0,
                F.concat(F.lit("part "), i.cast("string"), F.lit(" of recording "), F.col("video_id").cast("string")),
            ).alias("summary"),
        )
    )


CTES["topic_points"] = (
    ("frames",),
    """SELECT video_id, ord, timestamp_sec FROM frames WHERE event_type = 'signup'""",
)


def topic_points(spark: SparkSession, folder: str) -> DataFrame:
    return frames(spark, folder).where("event_type = 'signup'").select("video_id", "ord", "timestamp_sec")


CTES["slides"] = (
    ("frames",),
    """SELECT *, event_type IN ('view', 'click') AS is_slide, event_type = 'click' AS contains_graph,
              quality_score > 400 AS contains_equation
       FROM frames""",
)


def loose_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose place in their recording is not asked for; ``timestamp_sec`` is the event's own time.

    Without the join to recordings an aggregation over them combines map-side, also where one
    recording holds most rows.
    """
    return events(spark, folder).select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("ord"),
        (F.col("us") / F.lit(1e6)).alias("timestamp_sec"),
        F.col("value").alias("quality_score"),
        "event_type",
        (F.col("event_type") == "view").alias("is_scene_boundary"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("phash"),
    )


def slides(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with routing flags."""
    return flagged(frames(spark, folder))


def flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "is_slide": F.col("event_type").isin("view", "click"),
            "contains_graph": F.col("event_type") == "click",
            "contains_equation": F.col("quality_score") > 400,
        }
    )


# --- captions: embeddings of one label ------------------------------------------------------

CTES["captions"] = (
    (),
    """
    SELECT label AS video_id, vec_id AS ord, CAST(10 * vec_id AS DOUBLE) AS from_sec,
           CAST(10 * vec_id + 3 + vec_id % 5 AS DOUBLE) AS to_sec,
           CASE WHEN vec_id % 11 = 0 THEN '' ELSE 'caption ' || vec_id || ' of recording ' || label END AS text,
           embedding
    FROM embeddings""",
)


def captions(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("vec_id")
    return load(spark, folder, "embeddings").select(
        F.col("label").alias("video_id"),
        v.alias("ord"),
        (10 * v).cast("double").alias("from_sec"),
        (10 * v + 3 + v % 5).cast("double").alias("to_sec"),
        F.when(v % 11 == 0, F.lit("")).otherwise(
            F.concat(
                F.lit("caption "), v.cast("string"), F.lit(" of recording "), F.col("label").cast("string")
            )
        ).alias("text"),
        "embedding",
    )


# --- boxes: the lines of an order -----------------------------------------------------------

_LINE = (
    "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
CTES["boxes"] = (
    (),
    f"""
    SELECT l_orderkey AS frame_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS box_index,
           CAST(l_partkey % 100 - 10 AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y,
           l_quantity AS w, CAST(10 * l_linenumber AS DOUBLE) AS h,
           CASE l_returnflag || l_linestatus
             WHEN 'AF' THEN 'figure' WHEN 'NO' THEN 'abandon' WHEN 'RF' THEN 'person'
             WHEN 'AO' THEN 'plain text' WHEN 'NF' THEN 'table' ELSE 'isolate_formula' END AS cls,
           l_discount * 10 AS score, 100 AS img_w, 50 AS img_h
    FROM lineitem""",
)


def boxes(spark: SparkSession, folder: str, numbered: bool = True) -> DataFrame:
    """Detected boxes: the lines of an order; the frame is the order.

    ``l_linenumber`` repeats inside an order, so boxes are numbered over all columns. Plans
    that do not look at the number skip that.
    """
    lines = load(spark, folder, "lineitem")
    flags = F.concat("l_returnflag", "l_linestatus")
    names = {"AF": "figure", "NO": "abandon", "RF": "person", "AO": "plain text", "NF": "table"}
    cls = F.lit("isolate_formula")
    for flag, name in reversed(names.items()):
        cls = F.when(flags == flag, F.lit(name)).otherwise(cls)
    if numbered:
        lines = position(
            lines,
            ["l_orderkey"],
            [F.col(c.strip()) for c in _LINE.split(",")],
            F.floor(F.col("l_partkey") / 64),
            "box_index",
        )
    return lines.select(
        F.col("l_orderkey").alias("frame_id"),
        *(["box_index"] if numbered else []),
        (F.col("l_partkey") % 100 - 10).cast("double").alias("x"),
        (F.col("l_suppkey") % 50).cast("double").alias("y"),
        F.col("l_quantity").alias("w"),
        (10 * F.col("l_linenumber")).cast("double").alias("h"),
        cls.alias("cls"),
        (F.col("l_discount") * 10).alias("score"),
        F.lit(100).alias("img_w"),
        F.lit(50).alias("img_h"),
    )


# --- runs: the events of a user on one day --------------------------------------------------

STAGES = ("acquire", "keyframe", "detect", "select", "numerize", "build", "validate")
CTES["job_events"] = (
    (),
    """
    SELECT user_id || '-' || CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS job_id,
           event_id AS seq, epoch_us(ts) AS event_us,
           CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'enter' WHEN 'click' THEN 'enter'
                WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS event,
           ['acquire', 'keyframe', 'detect', 'select', 'numerize', 'build', 'validate']
             [1 + least(6, CAST(floor(value / 70) AS INTEGER))] AS stage,
           CASE WHEN event_type IN ('view', 'click') THEN epoch_us(ts) + 3600000000 END AS timeout_us,
           CASE WHEN event_type IN ('purchase', 'error') THEN CAST(floor(value) AS BIGINT) % 4 + 1 END AS attempt_count,
           CASE WHEN event_type = 'error' THEN 'error code ' || regexp_extract(props, '[0-9]+') END AS last_error
    FROM events""",
)


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """Job log: a job is one user on one day, every event one change of its state."""
    return job_events_of(events(spark, folder))


def job_events_of(source: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    stage = F.array(*[F.lit(s) for s in STAGES])[F.least(F.lit(6), F.floor(F.col("value") / 70).cast("int"))]
    day = F.floor(F.col("us") / F.lit(86400000000)).cast("string")
    return source.select(
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("us").alias("event_us"),
        F.when(kind == "signup", "create")
        .when(kind.isin("view", "click"), "enter")
        .when(kind == "purchase", "complete")
        .otherwise("fail")
        .alias("event"),
        stage.alias("stage"),
        F.when(kind.isin("view", "click"), F.col("us") + F.lit(3600000000)).alias("timeout_us"),
        F.when(kind.isin("purchase", "error"), F.floor("value") % 4 + 1).alias("attempt_count"),
        F.when(
            kind == "error", F.concat(F.lit("error code "), F.regexp_extract("props", "[0-9]+", 0))
        ).alias("last_error"),
    )
