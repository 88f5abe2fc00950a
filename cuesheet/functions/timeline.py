"""Scalar expressions over vectors, hashes, times, boxes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECILES = 10


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 1.0 for empty, unequal-length or zero vectors. Null if one is null."""

    def total(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    norms = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(~usable, F.lit(1.0))
        .when(norms == 0, F.lit(1.0))
        .otherwise(F.lit(1.0) - total(a, b) / norms)
    )


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit hashes stored as BIGINT."""
    return F.bit_count(a.bitwiseXOR(b))


def decile(t: Column, duration: Column) -> Column:
    """Tenth of the timeline a timestamp falls in; the end belongs to the last one."""
    tenth = (t / duration * F.lit(DECILES)).cast("int")
    last = F.lit(DECILES - 1)
    return F.when(duration <= 0, F.lit(0)).when(tenth > last, last).otherwise(tenth)


def minutes_seconds(seconds: Column) -> Column:
    """``MMmSSs`` after half-to-even rounding; minutes above 99 keep every digit."""
    total = F.bround(seconds, 0).cast("bigint")
    return F.format_string("%02dm%02ds", F.floor(total / 60), total % 60)


def keyframe_name(position: Column, t_start: Column, t_end: Column) -> Column:
    return F.concat(
        F.format_string("keyframe_%04d_[", position),
        minutes_seconds(t_start),
        F.lit("-"),
        minutes_seconds(t_end),
        F.lit("].jpeg"),
    )


def figure_key(stem: Column, timestamp_sec: Column, box_index: Column) -> Column:
    """First 16 hex digits of the SHA-1 of ``stem:second:box``; whole-frame figures use box -1."""
    parts = [stem, timestamp_sec.cast("int").cast("string"), box_index.cast("string")]
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 16)


def deck_fingerprint(video_id: Column, template_version: Column, generator_version: Column) -> Column:
    return F.sha2(F.concat_ws(":", video_id, template_version, generator_version), 256)


def clamped_box(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """Box cut to the image as ``struct<x,y,w,h>`` of ints; null when nothing is left."""

    def pin(value: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.bround(value, 0).cast("int"), limit.cast("int")))

    x0, y0, x1, y1 = pin(x, img_w), pin(y, img_h), pin(x + w, img_w), pin(y + h, img_h)
    return F.when(
        (x1 > x0) & (y1 > y0),
        F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")),
    )


# Detector class names and the content kind each stands for.
BOX_KINDS = {
    "figure": "diagram",
    "table": "table",
    "isolate_formula": "equation",
    "title": "text",
    "plain text": "text",
    "figure_caption": "text",
    "table_caption": "text",
    "formula_caption": "text",
    "abandon": "drop",
}
FIGURE_KINDS = ("diagram", "table", "equation")
TEXTUAL_KINDS = ("equation", "table", "text")


def box_kind(cls: Column) -> Column:
    """Content kind of a detector class; ``drop`` for page chrome, ``other`` when unknown."""
    pairs = [F.lit(part) for item in BOX_KINDS.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[cls], F.lit("other"))


def number_text(value: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        value.cast("string")
    )


def section_hint(from_sec: Column, to_sec: Column, title: Column, summary: Column) -> Column:
    head = F.concat(
        F.lit("["), number_text(from_sec), F.lit("-"), number_text(to_sec), F.lit("s] "), title
    )
    return F.when(F.coalesce(summary, F.lit("")) == "", head).otherwise(
        F.concat(head, F.lit(": "), summary)
    )


def caption_slice(t_start: Column, t_end: Column, hint: Column) -> Column:
    span = F.format_string("[%.1f, %.1f]", t_start, t_end)
    return F.when(F.coalesce(hint, F.lit("")) == "", span).otherwise(
        F.trim(F.concat(span, F.lit(" "), hint))
    )


def value_label(value: Column) -> Column:
    """Whole numbers as integers, others with four significant digits."""
    size = F.abs(value)
    # round() needs a constant scale, so scale by a power of ten around an integer rounding.
    power = F.pow(F.lit(10.0), F.lit(3) - F.floor(F.log10(size)))
    plain = F.format_string("%.8f", F.bround(value * power, 0) / power)
    return (
        F.when(value == F.floor(value), F.floor(value).cast("string"))
        .when(
            (size >= 9999.5) | (size < 0.000099995),
            F.regexp_replace(F.format_string("%.3e", value), r"\.?0+e", "e"),
        )
        .otherwise(F.regexp_replace(plain, r"\.?0+$", ""))
    )
