"""Deck type of a recording from its words (A10, A11, A13, A21). A narrow map: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.text import has_ranking_number, question_count

# The deck types in order, and the words whose presence speaks for each.
WORDS = {
    "explainer": [
        "explained", "what is", "introduction to", "intro to", "basics", "fundamental", "기초", "개념", "원리", "이해", "쉽게", "정리",
    ],
    "howto": [
        "how to", "how-to", "tutorial", "step by step", "guide", "setup", "set up", "install", "build a", "방법", "하는 법",
        "튜토리얼", "설치", "만들기", "셋업", "가이드", "따라하기",
    ],
    "review": [
        "review", "vs", "versus", "comparison", "compare", "best ", "worth it", "hands-on", "리뷰", "후기", "비교", "장단점", "추천", "내돈내산",
    ],
    "interview": [
        "interview", "podcast", "conversation with", "ama", "q&a", "qna", "sit down", "guest", "인터뷰", "팟캐스트", "대담", "문답", "초대",
    ],
    "news": [
        "news", "breaking", "what happened", "explained:", "report", "announce", "analysis", "뉴스", "속보", "사태", "발표", "분석",
        "정리해드립니다", "이슈",
    ],
    "listicle": [
        "top ", "best ", " ways", " things", " reasons", " tips", " tools", "ranking", "가지", "순위", "리스트", "베스트", "추천 ",
    ],
    "story": [
        "story of", "the rise", "the fall", "how they built", "case study", "documentary", "journey", "흥망", "사례", "이야기", "다큐", "성공기", "실패기",
    ],
    "talk": [
        "keynote", " talk", "ted", "tedx", "lecture", "presentation", "pitch", "강연", "발표", "키노트", "피치", "세미나",
    ],
}
DECK_TYPES = tuple(WORDS)
# Titles count most.
TITLE_WEIGHT, DESCRIPTION_WEIGHT = 3, 2
RANKING_BONUS, QUESTION_BONUS, QUESTION_MARKS = 3, 2, 8
SURE_ENOUGH = 0.45


def _words_in(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains.

    Hangul words are only looked for in texts that hold Hangul.
    """

    def count(wanted: list[str]) -> Column:
        if not wanted:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: F.contains(text, w)))

    plain = [w for w in words if w.isascii()]
    hangul = [w for w in words if not w.isascii()]
    return count(plain) + F.when(text.rlike("[가-힣]"), count(hangul)).otherwise(0)


def type_scores(items: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """Add ``scores``: one score per deck type. Needs ``title, description, transcript``.

    The whole transcript counts, or only its first ``sample_chars`` characters.
    """
    spoken = F.coalesce("transcript", F.lit(""))
    lowered = items.withColumns(
        {
            "_title": F.lower(F.coalesce("title", F.lit(""))),
            "_description": F.lower(F.coalesce("description", F.lit(""))),
            "_sample": spoken if sample_chars is None else F.substring(spoken, 1, sample_chars),
        }
    ).withColumn("_spoken", F.lower("_sample"))
    columns = []
    for deck_type, words in WORDS.items():
        score = (
            _words_in(F.col("_title"), words) * TITLE_WEIGHT
            + _words_in(F.col("_description"), words) * DESCRIPTION_WEIGHT
            + _words_in(F.col("_spoken"), words)
        )
        if deck_type == "listicle":
            score = score + F.when(has_ranking_number(F.col("title")), RANKING_BONUS).otherwise(0)
        if deck_type == "interview":
            asks = question_count(F.col("_sample")) >= QUESTION_MARKS
            score = score + F.when(asks, QUESTION_BONUS).otherwise(0)
        columns.append(score.cast("int").alias(deck_type))
    return lowered.withColumn("scores", F.struct(*columns)).drop(
        "_title", "_description", "_sample", "_spoken"
    )


def pick_type(scored: DataFrame) -> DataFrame:
    """Add ``type`` and ``confidence``: share of the top score and its lead over the second."""
    entries = F.array(
        *[
            F.struct((-F.col(f"scores.{t}")).alias("neg"), F.lit(i).alias("rank"), F.lit(t).alias("type"))
            for i, t in enumerate(DECK_TYPES)
        ]
    )
    total = sum((F.col(f"scores.{t}") for t in DECK_TYPES[1:]), F.col(f"scores.{DECK_TYPES[0]}"))
    top, second = -F.col("_ranked")[0]["neg"], -F.col("_ranked")[1]["neg"]
    confidence = F.least(F.lit(1.0), top / F.col("_total") * 0.6 + (top - second) / top * 0.4)
    return (
        scored.withColumns({"_ranked": F.array_sort(entries), "_total": total})
        .withColumns(
            {
                "type": F.when(top == 0, DECK_TYPES[0]).otherwise(F.col("_ranked")[0]["type"]),
                "confidence": F.when(top == 0, F.lit(0.2)).otherwise(F.round(confidence, 2)),
            }
        )
        .drop("_ranked", "_total")
    )


def route(picked: DataFrame, opinions: DataFrame, key: str, threshold: float = SURE_ENOUGH) -> DataFrame:
    """Keep a sure heuristic; otherwise take the second opinion, if its type is a known one.

    ``opinions(key, second_type, second_confidence)``; a missing opinion leaves the heuristic.
    """
    asked = F.col("confidence") < threshold
    joined = picked.join(opinions.withColumn("_given", F.lit(True)), key, "left")
    answered = asked & F.coalesce("_given", F.lit(False))
    known = answered & F.coalesce(F.col("second_type").isin(*DECK_TYPES), F.lit(False))
    return joined.withColumns(
        {
            "routed_type": F.when(known, F.col("second_type")).otherwise(F.col("type")),
            "routed_confidence": F.when(
                answered, F.coalesce("second_confidence", "confidence")
            ).otherwise(F.col("confidence")),
            "source": F.when(~asked, "heuristic").when(answered, "second").otherwise("heuristic(fallback)"),
        }
    ).drop("_given", "second_type", "second_confidence")


def collection_type(videos: DataFrame, group: str) -> DataFrame:
    """One deck type per collection by relevance-weighted vote (our rule; the source leaves it open)."""
    rank = F.create_map(*[F.lit(v) for i, t in enumerate(DECK_TYPES) for v in (t, i)])
    votes = videos.groupBy(group, "type").agg(F.sum("relevance_pct").alias("weight"))
    best = F.max_by(F.struct("type", "weight"), F.struct("weight", -rank[F.col("type")]))
    return votes.groupBy(group).agg(best.alias("_b")).select(group, "_b.type", "_b.weight")
