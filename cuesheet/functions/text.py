"""Text expressions: clipping, sentences, provenance phrases, counting."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The Python functions below travel to the executors inside the plan, so the package need not
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Wording that points at the source recording instead of the subject, removed
# from deck text.
PROVENANCE = (
    r"(?:이|본|그)\s*영상[^\s,.]*[\s,]*|영상\s*에서[^\s,.]*[\s,]*|본\s*강의[^\s,.]*[\s,]*"
    r"|강사님?[^\s,.]*[\s,]*|채널\s*구독[^\s,.]*\s*|구독.{0,8}좋아요\s*"
)
# Wording a finished slide must not contain.
META_PHRASE = (
    r"(?i)이\s*영상|영상\s*에서(?:는)?|본\s*강의|강사(?:님)?|채널\s*구독|구독.{0,15}좋아요"
    r"|출처\s*영상|동반\s*별첨|별첨|VIDEO\s*DIGEST|채널명"
)
CLOCK_TIME = r"\b\d{1,2}:\d{2}\b"
# A number that marks a ranking title.
RANKING_NUMBER = r"(?i)\b(?:top\s*)?\d{1,2}\b|\d{1,2}\s*(?:가지|개|선|위)"


def first_sentence(text: Column, limit: int = 90) -> Column:
    return F.substring(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。])\s")[0], 1, limit)


def clip_words(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, at the last space when that lies beyond 60% of the limit."""
    cut = F.substring(text, 1, limit)
    from_end = F.locate(" ", F.reverse(cut))
    last_space = F.when(from_end == 0, F.lit(-1)).otherwise(F.length(cut) - from_end)
    clipped = F.when(last_space > limit * 0.6, F.substring(cut, F.lit(1), last_space)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.trim(clipped))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def compose(text: Column) -> Column:
    """Unicode NFC. Only texts it could change are sent to Python; the others pass as null.

    Characters up to U+024F are stable under NFC unless a later one, such as a combining mark,
    is present.
    """
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{24F}]"), text)), text)


def subject_text(text: Column) -> Column:
    """Deck text: composed, without provenance phrases, runs of blanks squeezed, trimmed."""
    # Every provenance phrase holds one of these words, and looking for a word is much cheaper.
    composed = compose(text)
    holds = F.lit(False)
    for word in ("영상", "강의", "강사", "구독"):
        holds = holds | F.contains(composed, F.lit(word))
    bare = F.when(holds, F.regexp_replace(composed, PROVENANCE, "")).otherwise(composed)
    squeezed = F.regexp_replace(bare, r"\s{2,}", " ")
    return F.coalesce(F.regexp_replace(squeezed, r"^\s+|\s+$", ""), F.lit(""))


def narrative_sentences(text: Column, min_chars: int = 12) -> Column:
    """Trimmed sentences longer than ``min_chars``; the Korean ending counts as a stop."""
    parts = F.transform(F.split(text, r"(?<=[.!?…다])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > min_chars)


def leaf_name(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"[^/]*$", 0), F.lit(""))


def mask_video(message: Column, video_id: Column, label: Column) -> Column:
    """Replace the recording id by its anonymous label; without an id the message stays."""
    return F.when(F.coalesce(video_id, F.lit("")) == "", message).otherwise(F.replace(message, video_id, label))


def meta_hit(text: Column) -> Column:
    """First source phrase, else first clock time, else null."""
    phrase = F.regexp_extract(text, META_PHRASE, 0)
    clock = F.regexp_extract(text, CLOCK_TIME, 0)
    return F.when(phrase != "", phrase).when(clock != "", clock)


def question_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\?"))


def has_ranking_number(title: Column) -> Column:
    return title.rlike(RANKING_NUMBER)


def percent_text(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("n/a")).otherwise(
        F.concat(F.format_string("%.1f", part / whole * 100), F.lit("%"))
    )


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)
