"""Joins between points, intervals and keys (J family).

Time joins are equi-joins on ``(video_id, slot)``: intervals are repeated once per slot they
touch, and the exact time test is a residual. That spreads a hot recording over many tasks
and keeps the work near the number of true neighbours instead of all pairs of a recording.
The best match is an aggregate over the left row's key, which combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.ordering import TIME_SLOT_SEC, neighbours, slots_covered, time_slot
from cuesheet.session import stored

FRAME_KEY = ("video_id", "ord")
TOPIC_WINDOW_SEC = 3.0


def interval_best(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    best: Column,
    key: Sequence[str] = FRAME_KEY,
    width: float = TIME_SLOT_SEC,
) -> DataFrame:
    """Every left row with ``_best``, an aggregate over the right rows sharing a slot with it.

    ``best`` reads left columns by name and right columns through the struct ``r``. It must
    not mind seeing a right row more than once, as min, max and any do not.
    """
    lo, hi = left_span
    spread = right.select(
        "video_id",
        F.explode(slots_covered(*right_span, width)).alias("_slot"),
        F.struct(*right.columns).alias("r"),
    )
    if lo == hi:
        # A point has one slot, so grouping by it as well changes nothing but lets the
        # aggregation reuse the partitioning of the join.
        placed, group = left.withColumn("_slot", time_slot(lo, width)), [*key, "_slot"]
    else:
        covered = F.explode_outer(slots_covered(lo, hi, width))
        placed, group = left.withColumn("_slot", covered), list(key)
    others = [c for c in left.columns if c not in key]
    return (
        placed.join(spread, ["video_id", "_slot"], "left")
        .groupBy(*group)
        .agg(F.any_value(F.struct(*others)).alias("_row"), best.alias("_best"))
        .select(*key, "_row.*", "_best")
        .select(*left.columns, "_best")
    )


def best_overlap(frames: DataFrame, sections: DataFrame, width: float = TIME_SLOT_SEC) -> DataFrame:
    """Add the section a frame overlaps most, with ``overlap_sec``; both null without any.

    Touching counts as an overlap of zero; ties go to the earlier section.
    """
    overlap = F.least("t_end", "r.to_sec") - F.greatest("t_start", "r.from_sec")
    # least and greatest skip nulls, so a frame without a section must be kept out first.
    touches = F.col("r").isNotNull() & (overlap >= 0)
    best = F.max(
        F.when(touches, F.struct(overlap.alias("overlap"), (-F.col("r.index")).alias("rank")))
    )
    hits = interval_best(frames, sections, ("t_start", "t_end"), ("from_sec", "to_sec"), best, width=width)
    return hits.select(
        *frames.columns,
        (-F.col("_best.rank")).alias("overlap_section"),
        F.col("_best.overlap").alias("overlap_sec"),
    )


def containing_section(
    points: DataFrame, sections: DataFrame, default: int | None = 0, width: float = TIME_SLOT_SEC
) -> DataFrame:
    """First section with ``from_sec <= t < to_sec``; ``default`` otherwise, told apart by a flag."""
    inside = (F.col("timestamp_sec") >= F.col("r.from_sec")) & (
        F.col("timestamp_sec") < F.col("r.to_sec")
    )
    hits = interval_best(
        points,
        sections.where("from_sec is not null and to_sec is not null"),
        ("timestamp_sec", "timestamp_sec"),
        ("from_sec", "to_sec"),
        F.min(F.when(inside, F.col("r.index"))),
        width=width,
    )
    found = F.col("_best")
    return hits.select(
        *points.columns,
        (found if default is None else F.coalesce(found, F.lit(default))).alias("in_section"),
        found.isNotNull().alias("section_matched"),
    )


def topic_alignment(
    frames: DataFrame, points: DataFrame, window_sec: float = TOPIC_WINDOW_SEC
) -> DataFrame:
    """First topic point in list order within the window of a frame (not the nearest one)."""
    # Points at the same instant are interchangeable but for their rank: keep the first.
    single = points.groupBy("video_id", "timestamp_sec").agg(F.min("ord").alias("ord"))
    banded = single.withColumns(
        {"lo": F.col("timestamp_sec") - window_sec, "hi": F.col("timestamp_sec") + window_sec}
    )
    near = F.abs(F.col("timestamp_sec") - F.col("r.timestamp_sec")) <= window_sec
    best = F.min(F.when(near, F.struct("r.ord", "r.timestamp_sec")))
    hits = interval_best(
        frames, banded, ("timestamp_sec", "timestamp_sec"), ("lo", "hi"), best,
        width=max(window_sec, 1.0),
    )
    return hits.select(
        *frames.columns,
        F.col("_best.ord").alias("topic_ord"),
        F.col("_best.timestamp_sec").alias("topic_sec"),
        F.col("_best").isNotNull().alias("is_topic_aligned"),
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    right_time: str,
    right_rank: str,
    out: str,
    key: Sequence[str] = FRAME_KEY,
    width: float = TIME_SLOT_SEC,
) -> DataFrame:
    """Rank of the right row nearest in time to each left row; ties go to the lowest rank.

    A left row without a time stays and gets null; right rows without a time are near to nothing.

    Both sides are laid on one time line and the neighbour on either side is carried to the
    left rows, so no pair of rows is ever formed.
    """
    others = [c for c in left.columns if c != "video_id"]
    marks = right.where(F.col(right_time).isNotNull()).groupBy("video_id", F.col(right_time).alias("_t")).agg(
        F.min(right_rank).alias("_rank")
    )
    line = (
        left.select("video_id", F.col("timestamp_sec").alias("_t"), F.lit(1).alias("_side"), F.struct(*others).alias("_row"))
        .unionByName(
            marks.select(
                "video_id", "_t", F.lit(0).alias("_side"),
                F.struct(F.col("_t").alias("t"), F.col("_rank").alias("rank")).alias("_mark"),
            ),
            allowMissingColumns=True,
        )
    )
    sided = neighbours(line, ["video_id"], ["_t", "_side"], time_slot("_t", width), "_mark")

    def candidate(side: str) -> Column:
        return F.when(
            F.col(side).isNotNull() & F.col("_t").isNotNull(),
            F.struct(
                F.abs(F.col(f"{side}.t") - F.col("_t")).alias("gap"),
                F.col(f"{side}.rank").alias("rank"),
            ),
        )

    return sided.where("_side = 1").select(
        "video_id", "_row.*", F.least(candidate("_before"), candidate("_after")).alias("_best")
    ).select(*left.columns, F.col("_best.rank").alias(out))


def frames_in_windows(frames: DataFrame, windows: DataFrame, width: float = TIME_SLOT_SEC) -> DataFrame:
    """Frames inside any requested ``[lo, hi]``; overlapping windows do not repeat a frame."""
    spread = windows.select(
        "video_id", F.explode(slots_covered("lo", "hi", width)).alias("_slot"), "lo", "hi"
    )
    f = frames.withColumn("_slot", time_slot("timestamp_sec", width)).alias("f")
    w = spread.alias("w")
    inside = (
        (F.col("f.video_id") == F.col("w.video_id"))
        & (F.col("f._slot") == F.col("w._slot"))
        & F.col("f.timestamp_sec").between(F.col("w.lo"), F.col("w.hi"))
    )
    return f.join(w, inside, "left_semi").drop("_slot")


def resolve_figures(refs: DataFrame, assets: DataFrame, tables: DataFrame) -> DataFrame:
    """References with their rendered asset or native table; unresolved ones are dropped.

    ``refs(deck_id, ref_ord, figure_id, kind)``, ``assets(deck_id, figure_id, asset, ord)``,
    ``tables(deck_id, figure_id, headers, rows, ord)``. For a repeated id the last row wins; a
    table reference prefers a usable native table.
    """
    key = ["deck_id", "figure_id"]
    last_asset = assets.groupBy(*key).agg(F.max_by("asset", "ord").alias("asset"))
    last_table = (
        tables.groupBy(*key)
        .agg(F.max_by(F.struct("headers", "rows"), "ord").alias("_t"))
        .select(*key, "_t.*")
    )
    native = (F.col("kind") == "table") & (F.size("headers") > 0) & (F.size("rows") > 0)
    return (
        refs.join(last_asset, key, "left")
        .join(last_table, key, "left")
        .withColumn(
            "slide_kind",
            F.when(F.coalesce(native, F.lit(False)), "table").when(F.col("asset").isNotNull(), "image"),
        )
        .where(F.col("slide_kind").isNotNull())
    )


def midpoint_sections(frames: DataFrame, sections: DataFrame, width: float = TIME_SLOT_SEC) -> DataFrame:
    """Frames and sections paired by the frame's midpoint; unpaired rows of both sides stay.

    On a shared edge the earlier section is taken.
    """
    mid = frames.withColumn("_mid", (F.col("t_start") + F.col("t_end")) / 2)
    inside = F.col("_mid").between(F.col("r.from_sec"), F.col("r.to_sec"))
    paired = interval_best(
        mid, sections, ("_mid", "_mid"), ("from_sec", "to_sec"),
        F.min(F.when(inside, F.col("r.index"))), width=width,
    ).select("video_id", "ord", F.col("_best").alias("index"))
    used = paired.where("index is not null").select("video_id", "index").distinct()
    text_only = sections.join(used, ["video_id", "index"], "left_anti").select("video_id", "index")
    return paired.withColumn(
        "pairing", F.when(F.col("index").isNull(), "data_only").otherwise("paired")
    ).unionByName(text_only.withColumn("pairing", F.lit("text_only")), allowMissingColumns=True)


def attach_figures(figures: DataFrame, sections: DataFrame, width: float = TIME_SLOT_SEC) -> DataFrame:
    """Half-open section of each figure, else the section starting nearest; dropped ones stay out."""
    live = figures.where("manifest_status <> 'dropped'")
    # Stored, for both kinds of figures are taken from it.
    inside = stored(containing_section(live, sections, default=None, width=width))
    hit = inside.where("section_matched").withColumn("attached_by", F.lit("window"))
    missed = inside.where("not section_matched").drop("in_section")
    filled = nearest(missed, sections, "from_sec", "index", "in_section", width=width)
    return hit.unionByName(filled.withColumn("attached_by", F.lit("nearest"))).drop("section_matched")


def segment_figures(segments: DataFrame, figures: DataFrame, width: float = TIME_SLOT_SEC) -> DataFrame:
    """Segments with the figures inside ``[from_sec, to_sec]``, one row per pair.

    Only segments routed to figures look for any; a segment without figures has one row with
    a null ``figure_ord``.
    """
    wanted = segments.where("path = 'path1_figure'").select(
        "video_id", "pos", "from_sec", "to_sec", F.explode(slots_covered("from_sec", "to_sec", width)).alias("_slot")
    )
    points = figures.select(
        "video_id", time_slot("timestamp_sec", width).alias("_slot"),
        F.col("ord").alias("figure_ord"), F.col("timestamp_sec").alias("figure_sec"),
    )
    pairs = (
        wanted.join(points, ["video_id", "_slot"])
        .where(F.col("figure_sec").between(F.col("from_sec"), F.col("to_sec")))
        .select("video_id", "pos", "figure_ord", "figure_sec")
    )
    return segments.join(pairs, ["video_id", "pos"], "left")


def text_with_figures(sections: DataFrame, figures: DataFrame, width: float = TIME_SLOT_SEC) -> DataFrame:
    """Sections with the figures in ``[from_sec, to_sec)``, one row per pair, lone sections kept."""
    spread = sections.select(
        "video_id", "index", "from_sec", "to_sec", F.explode(slots_covered("from_sec", "to_sec", width)).alias("_slot")
    )
    points = figures.select(
        "video_id", time_slot("timestamp_sec", width).alias("_slot"),
        F.col("ord").alias("figure_ord"), F.col("timestamp_sec").alias("figure_sec"),
    )
    pairs = spread.join(points, ["video_id", "_slot"]).where(
        (F.col("figure_sec") >= F.col("from_sec")) & (F.col("figure_sec") < F.col("to_sec"))
    )
    return sections.join(pairs.select("video_id", "index", "figure_ord", "figure_sec"), ["video_id", "index"], "left")


def new_manifests(manifests: DataFrame, processed: DataFrame) -> DataFrame:
    return manifests.join(processed.select("manifest_id").distinct(), "manifest_id", "left_anti")


def card_videos(cards: DataFrame, states: DataFrame, videos: DataFrame) -> DataFrame:
    """Card to video over the state table; a wrong owner or a missing hop gives a reason."""
    return (
        cards.join(states.withColumnRenamed("user_id", "owner_id"), "card_id", "left")
        .join(videos, "video_ref", "left")
        .withColumn(
            "reject_reason",
            F.when(F.col("owner_id").isNull(), "card_missing")
            .when(F.col("user_id").isNotNull() & (F.col("user_id") != F.col("owner_id")), "not_owner")
            .when(F.col("external_id").isNull(), "video_missing"),
        )
        .withColumn("external_id", F.when(F.col("reject_reason").isNull(), F.col("external_id")))
    )


def collection_rollup(
    collections: DataFrame, sectors: DataFrame, videos: DataFrame, sections: DataFrame
) -> DataFrame:
    """Collection, sector, video and section in one row per section; the source video is kept."""
    return (
        sections.join(videos, "video_id")
        .join(sectors, "sector_id")
        .join(collections, "collection_id")
    )


def flag_boundaries(captions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Flag every segment that starts at a boundary time, also when two share it."""
    starts = boundaries.select(
        "video_id", F.col("timestamp_sec").alias("from_sec"), F.lit(True).alias("_hit")
    ).distinct()
    return (
        captions.join(starts, ["video_id", "from_sec"], "left")
        .withColumn("is_topic_boundary", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )
