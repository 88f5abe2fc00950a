"""Top-k, caps and numeric orders (L family).

``row_number() <= k`` is limited map-side by Spark, so a hot group sends k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUEST_FRAMES = 4
BOX_CAP = 50
BOX_MIN_SCORE = 0.15


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def request_frames(frames: DataFrame, group: Sequence[str] = ("video_id",), k: int = REQUEST_FRAMES) -> DataFrame:
    """Most figure boxes first, then time."""
    order = [F.col("fig_box_count").desc(), F.col("timestamp_sec"), F.col("ord")]
    return top_k(frames, group, order, k)


def strongest_boxes(boxes: DataFrame, k: int = BOX_CAP, min_score: float = BOX_MIN_SCORE) -> DataFrame:
    strong = boxes.where(F.col("score") >= min_score)
    return top_k(strong, ["frame_id"], [F.col("score").desc(), F.col("box_index")], k)


def review_picks(runs: DataFrame) -> DataFrame:
    """First and middle run of each report, given ``pos`` and ``n`` (see ``ordering.position``)."""
    return runs.where((F.col("pos") == 0) | (F.col("pos") == F.expr("n div 2")))


# Most items a recipe takes from its main list.
RECIPE_CAPS = {
    "explainer": 8, "howto": 8, "review": 6, "interview": 6, "news": 6, "listicle": 10, "story": 6, "talk": 6,
}
LISTICLE_DEEP_CAP = 8
# Table rows, Q&A pairs, roadmap stages, map chapters and map concepts per deck.
DECK_CAPS = {"table_rows": 6, "qa": 4, "roadmap": 5, "map_chapters": 6, "map_concepts": 6}


def recipe_cap(deck_type: Column) -> Column:
    pairs = [F.lit(v) for item in RECIPE_CAPS.items() for v in item]
    return F.create_map(*pairs)[deck_type]


def first_items(items: Column, k: int) -> Column:
    return F.slice(items, 1, k)


def highlight_atoms(atoms: DataFrame, k: int = 4) -> DataFrame:
    return top_k(atoms.where(F.col("type").isin("fact", "tip")), ["video_id"], [F.col("ord")], k)


# Question quota by level, in order of preference, and the total.
QA_QUOTA = {"advanced": 3, "intermediate": 3, "foundational": 2}
QA_TOTAL = 8


def quota_questions(pairs: DataFrame) -> DataFrame:
    """Per recording the first pairs of each level up to its quota, hardest level first."""
    levels = list(QA_QUOTA)
    quota = F.create_map(*[F.lit(v) for item in QA_QUOTA.items() for v in item])
    level_rank = F.create_map(*[F.lit(v) for i, lv in enumerate(levels) for v in (lv, i)])
    widest = top_k(
        pairs.where(F.col("level").isin(*levels)), ["video_id", "level"], [F.col("ord")], max(QA_QUOTA.values()), "_n"
    ).where(F.col("_n") <= quota[F.col("level")])
    return top_k(widest, ["video_id"], [level_rank[F.col("level")], F.col("ord")], QA_TOTAL).drop("_n")


def best_sections(sections: DataFrame, k: int) -> DataFrame:
    """Sections of a sector by video relevance times section relevance."""
    scored = sections.withColumn("score", F.col("video_relevance") * F.col("section_relevance"))
    return top_k(scored, ["sector_id"], [F.col("score").desc(), F.col("video_id"), F.col("ord")], k)


def slide_number(file_name: Column) -> Column:
    """Number in a slide's file name, for numeric order."""
    return F.regexp_extract(F.regexp_extract(file_name, r"[^/]*$", 0), r"\d+", 0).cast("int")
