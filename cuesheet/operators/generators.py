"""Row generators: samples, fills, windows, grids and pages (G family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.timeline import DECILES, decile
from cuesheet.session import stored

SAMPLE_STEP_SEC = 2.5
SAMPLE_CAP = 10
LONG_SCENE_GAP_SEC = 20.0
END_GUARD_SEC = 0.5
REQUEST_HALF_SEC = 10.0


def scene_samples(scenes: DataFrame) -> DataFrame:
    """The start of every scene plus even points inside it, denser only when it is long.

    ``scenes(video_id, ord, start, end)``. All samples carry the interval of their scene, and the
    ``duration`` of their recording where scenes have it.
    """
    span = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    cap = F.greatest(F.lit(SAMPLE_CAP), F.floor(span / LONG_SCENE_GAP_SEC) + 1)
    inner = F.when(span <= SAMPLE_STEP_SEC, F.lit(0)).otherwise(
        F.least(F.floor(span / SAMPLE_STEP_SEC), cap - 1)
    )
    step = span / (F.col("_inner") + 1)
    at = F.col("start") + step * F.col("_k")
    return (
        scenes.withColumn("_inner", inner)
        .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_inner").cast("bigint"))))
        .where((F.col("_k") == 0) | (at < F.col("end") - END_GUARD_SEC))
        .select(
            "video_id",
            "ord",
            F.col("_k").alias("sample"),
            F.when(F.col("_k") == 0, F.col("start")).otherwise(at).alias("timestamp_sec"),
            F.col("start").alias("t_start"),
            F.col("end").alias("t_end"),
            (F.col("_k") == 0).alias("is_scene_boundary"),
            *[c for c in scenes.columns if c == "duration"],
        )
    )


def missing_deciles(samples: DataFrame, durations: DataFrame) -> DataFrame:
    """``(video_id, section_index, duration)`` for every tenth without a sample.

    The tenths with samples are one set of bits a recording, combined map-side where samples carry
    their ``duration``; the missing ones are the rest of the bits.
    """
    live = durations.where("duration > 0").select("video_id", "duration")
    timed = samples if "duration" in samples.columns else samples.join(live, "video_id")
    tenth = decile(F.col("timestamp_sec"), F.col("duration"))
    covered = timed.where("duration > 0").groupBy("video_id").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), tenth)).alias("_covered")
    )
    tenths = F.sequence(F.lit(0), F.lit(DECILES - 1))
    bits = F.coalesce("_covered", F.lit(0))
    missing = F.filter(tenths, lambda i: bits.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) == 0)
    return live.join(covered, "video_id", "left").select("video_id", F.explode(missing).alias("section_index"), "duration")


def decile_fills(missing: DataFrame) -> DataFrame:
    """A sample in the middle of each missing tenth, standing for that tenth."""
    lo = F.col("section_index") / DECILES * F.col("duration")
    hi = (F.col("section_index") + 1) / DECILES * F.col("duration")
    return missing.select(
        "video_id",
        ((lo + hi) / 2).alias("timestamp_sec"),
        lo.alias("t_start"),
        hi.alias("t_end"),
        F.lit(False).alias("is_scene_boundary"),
    )


def candidates(scenes: DataFrame, durations: DataFrame) -> DataFrame:
    """Scene samples and decile fills in one bag.

    Scenes are stored, as samples and covered tenths are both made of them.
    """
    samples = scene_samples(stored(scenes))
    fills = decile_fills(missing_deciles(samples, durations))
    return samples.drop("ord", "sample", "duration").unionByName(fills)


def with_forced_grabs(pool: DataFrame, points: DataFrame) -> DataFrame:
    """Pool plus a grab at every key-point or atom time."""
    grabs = points.select(
        "video_id",
        "timestamp_sec",
        F.col("timestamp_sec").alias("t_start"),
        F.col("timestamp_sec").alias("t_end"),
        F.lit(False).alias("is_scene_boundary"),
    )
    return pool.unionByName(grabs)


def request_windows(requests: DataFrame, half_sec: float = REQUEST_HALF_SEC) -> DataFrame:
    """``requests(video_id, timestamps array<double>)`` to one closed window per timestamp."""
    return requests.select("video_id", F.posexplode("timestamps").alias("request", "at")).where("at is not null").select(
        "video_id",
        F.col("request").cast("bigint").alias("request"),
        F.greatest(F.lit(0.0), F.col("at") - half_sec).alias("lo"),
        (F.col("at") + half_sec).alias("hi"),
    )


def in_any_window(t: Column, timestamps: Column, half_sec: float = REQUEST_HALF_SEC) -> Column:
    """Same test as an expression, for a short list beside the row."""
    return F.exists(
        timestamps, lambda at: t.between(F.greatest(F.lit(0.0), at - half_sec), at + half_sec)
    )


def sample_grid(sections: DataFrame, rate: float = 1.0) -> DataFrame:
    """Evenly spaced times in ``[from_sec, to_sec)``."""
    n = F.ceil((F.col("to_sec") - F.col("from_sec")) * rate)
    return (
        sections.where(n > 0)
        .withColumn("tick", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
        .withColumn("timestamp_sec", F.col("from_sec") + F.col("tick") / F.lit(rate))
    )


ATOMS_PER_PAGE = 6
THIN_PAGE_CHARS = 150


def body_pages(sections: DataFrame) -> DataFrame:
    """Pages of a section: its atoms dealt evenly, at most six a page.

    ``sections`` needs ``atoms array<string>``, ``sentences array<string>``, ``narrative`` and
    ``title``; without atoms the narrative is the page, without that the title. A page under
    150 characters takes unused narrative sentences in order until it is long enough.
    """
    filled = F.filter("atoms", lambda a: a != "")
    source = (
        F.when(F.size(filled) > 0, filled)
        .when(F.col("narrative") != "", F.array("narrative"))
        .otherwise(F.array(F.when(F.col("title") != "", F.col("title")).otherwise(F.lit("—"))))
    )
    n = F.size("_source")
    pages = F.greatest(F.lit(1), F.ceil(n / ATOMS_PER_PAGE)).cast("int")
    per = F.ceil(n / F.col("_pages")).cast("int")
    return (
        sections.withColumn("_source", source)
        .withColumn("_pages", pages)
        .withColumn("page", F.explode(F.sequence(F.lit(0), F.col("_pages") - 1)))
        .withColumn("_own", F.slice("_source", F.col("page") * per + 1, per))
        .where(F.size("_own") > 0)
        .withColumn("bullets", _topped_up(F.col("_own"), F.col("_source"), F.col("sentences")))
        .withColumnRenamed("_pages", "n_pages")
        .drop("_source", "_own")
    )


def _topped_up(page: Column, source: Column, sentences: Column) -> Column:
    def chars(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda total, s: total + F.length(s))

    def add(items: Column, sentence: Column) -> Column:
        fits = (
            (chars(items) < THIN_PAGE_CHARS)
            & ~F.array_contains(items, sentence)
            & ~F.array_contains(source, sentence)
        )
        return F.when(fits, F.concat(items, F.array(sentence))).otherwise(items)

    return F.aggregate(sentences, page, add)


def chunks(items: DataFrame, pos: str, size: int = 4) -> DataFrame:
    """Number the page of each item when ``size`` items share a page."""
    return items.withColumn("page", F.floor(F.col(pos) / size))
