"""Gates and predicates (P family).

A gate is a column with the reason of the first failing test, null when the row passes, so
rejects stay queryable: see ``split``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import structs
from cuesheet.functions.text import edit_share
from cuesheet.functions.timeline import FIGURE_KINDS, TEXTUAL_KINDS, box_kind, clamped_box


def split(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that do not."""
    return df.where(F.col(reason).isNull()), df.where(F.col(reason).isNotNull())


# --- summaries and sections -----------------------------------------------------------------


def summary_reason(
    present: Column, template_version: Column, quality_flag: Column, transcript_used: Column
) -> Column:
    return (
        F.when(~present, "missing")
        .when(~(template_version.eqNullSafe(F.lit("v2"))), "template_version")
        .when(~(quality_flag.eqNullSafe(F.lit("pass"))), "quality_flag")
        .when(~F.coalesce(transcript_used, F.lit(False)), "transcript_used")
    )


def gate_summaries(requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every requested video with ``gate_reason``; a video without a summary is ``missing``."""
    found = summaries.withColumn("_present", F.lit(True))
    return (
        requests.join(found, "video_id", "left")
        .withColumn(
            "gate_reason",
            summary_reason(
                F.coalesce("_present", F.lit(False)),
                F.col("template_version"),
                F.col("quality_flag"),
                F.col("transcript_used"),
            ),
        )
        .drop("_present")
    )


def relevance_path(relevance_pct: Column, has_visual: Column, threshold: float = 60) -> Column:
    return F.when((relevance_pct >= threshold) & has_visual, "path1_figure").otherwise("path2_text")


def section_display(relevance_pct: Column, has_figure: Column, threshold: float = 20) -> Column:
    """Sections of low relevance keep an agenda line only, unless they hold a figure atom."""
    return F.when((relevance_pct < threshold) & ~has_figure, "agenda_only").otherwise("full")


def low_alignment(relevance_pct: Column, threshold: float = 30) -> Column:
    return relevance_pct < threshold


# Content types that decide whether a recording usually shows figures.
TEXT_TYPES = ("vlog", "interview", "podcast")
FIGURE_TYPES = ("lecture", "tutorial", "presentation")
# Our cue list, a parameter of ``needs_figure``: the words a section uses when it shows something.
FIGURE_CUES = r"(?i)\b(?:graph|chart|table|equation|formula|diagram)s?\b|\\(?:frac|sum|int)\b"


def needs_figure(content_type: Column, text: Column, cues: str = FIGURE_CUES) -> Column:
    """The content type decides; an undecided type is settled by cues in the text."""
    return (
        F.when(content_type.isin(*TEXT_TYPES), False)
        .when(content_type.isin(*FIGURE_TYPES), True)
        .otherwise(F.coalesce(text.rlike(cues), F.lit(False)))
    )


# --- frames and boxes -----------------------------------------------------------------------

MIN_TEXT_SHARE = 0.02
STRONG_FIGURE_SCORE = 0.80
LARGE_FIGURE_SHARE = (0.20, 0.85)
RESCUE_BOXES = 2


def frame_content(boxes: DataFrame, group: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Per frame: does it hold real content, and how many figure boxes. One aggregation.

    Boxes of unknown class count as content, page chrome does not.
    """
    kind, area = F.col("_kind"), F.col("w") * F.col("h")
    frame_area = F.col("img_w").cast("double") * F.col("img_h")
    low, high = LARGE_FIGURE_SHARE
    text = kind.isin(*TEXTUAL_KINDS) & (area >= MIN_TEXT_SHARE * frame_area)
    strong = (kind == "diagram") & (F.col("score") >= STRONG_FIGURE_SCORE)
    large = (kind == "diagram") & area.between(low * frame_area, high * frame_area)
    return (
        boxes.withColumn("_kind", box_kind(F.col("cls")))
        .where("_kind <> 'drop'")
        .groupBy(*group)
        .agg(
            F.bool_or(text).alias("_text"),
            F.bool_or(strong).alias("_strong"),
            F.bool_or(large).alias("_large"),
            F.count(F.lit(1)).alias("content_boxes"),
            F.count_if(kind.isin(*FIGURE_KINDS)).alias("fig_box_count"),
        )
        .withColumn(
            "has_content",
            F.col("_text")
            | F.col("_strong")
            | (F.col("_large") & (F.col("content_boxes") >= RESCUE_BOXES)),
        )
        .drop("_text", "_strong", "_large")
    )


def gate_frames(frames: DataFrame, content: DataFrame) -> DataFrame:
    """Frames with ``keep``. Frames whose detection failed, or without an area, are kept; frames
    without boxes are not; when nothing of a recording would be left, all of it is kept.

    ``frames`` needs ``video_id, frame_id, detect_error, frame_area``.
    """
    judged = frames.join(content, "frame_id", "left").withColumns(
        {
            "fig_box_count": F.coalesce("fig_box_count", F.lit(0)),
            "_keep": F.coalesce("detect_error", F.lit(False))
            | (F.col("frame_area") <= 0)
            | F.coalesce("has_content", F.lit(False)),
        }
    )
    # Aggregated and joined back, not a window: one recording may be very long.
    alive = judged.groupBy("video_id").agg(F.bool_or("_keep").alias("_alive"))
    return (
        judged.join(alive, "video_id")
        .withColumn("starved", ~F.col("_alive"))
        .withColumn("keep", F.col("_keep") | F.col("starved"))
        .drop("_keep", "_alive")
    )


def keyframe_figures(slides: DataFrame) -> DataFrame:
    """Slides without graph or equation as whole-frame figures with the selection score."""
    return slides.where(~F.col("contains_graph") & ~F.col("contains_equation")).withColumn(
        "kind", F.lit("keyframe")
    )


# Crop kinds that veto a figure, and kinds that are figures.
REJECT_KINDS = ("handwriting", "title", "decoration", "ui_badge", "text", "photo", "none")
CROP_FIGURE_KINDS = ("chart", "diagram", "table", "equation", "screenshot")
CONFIDENCE_FLOOR = 0.55
CONFIDENCE_FLAG = 0.7
MAX_CROP_SHARE = 0.85


def crop_reason(double_read: bool = True) -> Column:
    """First gate a classified crop fails.

    Needs ``x, y, w, h, img_w, img_h, kind, kind_second, confidence, struct`` with the struct as
    JSON text.
    """
    box = clamped_box(*[F.col(c) for c in ("x", "y", "w", "h", "img_w", "img_h")])
    share = box["w"].cast("double") * box["h"] / (F.col("img_w").cast("double") * F.col("img_h"))
    flat_claim = structs.once(F.from_json("struct", structs.CHART), structs.chart_contradicts_insight)
    sound = structs.once(F.from_json("struct", structs.DIAGRAM), structs.diagram_is_consistent)
    kind = F.col("kind")
    reason = (
        F.when(box.isNull(), "empty_crop")
        .when(share > MAX_CROP_SHARE, "oversize")
        .when(kind.isNull() | kind.isin(*REJECT_KINDS) | ~kind.isin(*CROP_FIGURE_KINDS), "reject_kind")
    )
    if double_read:
        reason = reason.when(~kind.eqNullSafe(F.col("kind_second")), "kinds_disagree")
    return (
        reason.when(
            F.col("confidence").isNull() | (F.col("confidence") < CONFIDENCE_FLOOR), "low_confidence"
        )
        .when(flat_claim, "chart_inconsistent")
        .when(~sound, "diagram_inconsistent")
    )


def confidence_status(confidence: Column, threshold: float = CONFIDENCE_FLAG) -> Column:
    return F.when(confidence < threshold, "unverified").otherwise("pending")


def confidence_tier(confidence: Column, verified: float = 0.85, floor: float = 0.55) -> Column:
    return (
        F.when(confidence >= verified, "verified")
        .when(confidence >= floor, "unverified")
        .otherwise("dropped")
    )


def outside_axis(ys: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.exists(ys, lambda y: (y < low) | (y > high)), F.lit(False))


def readings_agree(a: Column, b: Column, limit: float = 0.10) -> Column:
    return edit_share(a, b) < limit


# --- runs and jobs --------------------------------------------------------------------------

# Wording of acquire errors that blame the input, not the system.
UNSUITABLE = (
    r"(?i)video unavailable|private video|members-only|has been removed|not available"
    r"|age[- ]restricted|account .* terminated"
)
# Job stages, statuses and the default attempt budget.
JOB_STAGES = ("acquire", "keyframe", "detect", "select", "numerize", "build", "validate")
JOB_STATUSES = ("queued", "running", "done", "error")
MAX_ATTEMPTS = 2
STAGE_ALIASES = {"recognize": "numerize"}
FRAME_TYPES = ("title_card", "diagram", "chart", "table", "face", "b_roll")


def input_unsuitable(stage: Column, error: Column, gate_reason: Column) -> Column:
    return gate_reason.isNotNull() | F.coalesce(
        (stage == "acquire") & error.rlike(UNSUITABLE), F.lit(False)
    )


def failure_stage(stage: Column) -> Column:
    """Alias first, then the known stages, else null."""
    named = stage
    for alias, target in STAGE_ALIASES.items():
        named = F.when(stage == alias, F.lit(target)).otherwise(named)
    return F.when(named.isin(*JOB_STAGES), named)


def duration_reason(actual: Column, expected: Column, tolerance: float = 0.10) -> Column:
    return F.when(expected <= 0, "bad_expected").when(
        F.abs(actual - expected) / expected > tolerance, "duration_mismatch"
    )


def timed_out(status: Column, timeout_at: Column, as_of: Column) -> Column:
    return F.coalesce((status == "running") & (as_of > timeout_at), F.lit(False))


def routing_defaults(raw: Column) -> dict[str, Column]:
    """Columns of a routing row from a possibly incomplete struct."""
    kind = raw["frame_type"]
    return {
        "is_slide": F.coalesce(raw["is_slide"], F.lit(False)),
        "contains_graph": F.coalesce(raw["contains_graph"], F.lit(False)),
        "contains_equation": F.coalesce(raw["contains_equation"], F.lit(False)),
        "frame_type": F.when(kind.isin(*FRAME_TYPES), kind).otherwise("b_roll"),
        "summary_hint": raw["summary_hint"],
        "confidence": F.coalesce(raw["confidence"], F.lit(0.0)),
    }


def job_row_reasons() -> Column:
    """Violated domain checks of a job row, as an array of names."""
    checks = {
        "stage": F.col("stage").isin(*JOB_STAGES),
        "status": F.col("status").isin(*JOB_STATUSES),
        "failure_stage": F.col("failure_stage").isNull() | F.col("failure_stage").isin(*JOB_STAGES),
    }
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.array_compact(F.array(*marks))
