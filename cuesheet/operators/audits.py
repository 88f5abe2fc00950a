"""Audits of decks and figure manifests (V family, A15-A18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.text import edit_share, meta_hit

EMU_PER_INCH = 914400.0
PAGE_INCHES = (13.333, 7.5)
TOLERANCE_EMU = 30000
BODY_TOP_INCHES = 1.45
MIN_CHARS = {"dark": 110, "light": 160}
BODY_SHAPES = 8
LOW_EDGE_INCHES, HIGH_START_INCHES = 5.0, 2.0
MIN_SLIDES = 12


def overflows() -> Column:
    """A text shape reaches beyond the slide."""
    width, height = (side * EMU_PER_INCH + TOLERANCE_EMU for side in PAGE_INCHES)
    outside = (
        (F.col("x") + F.col("cx") > width)
        | (F.col("y") + F.col("cy") > height)
        | (F.col("x") < -TOLERANCE_EMU)
        | (F.col("y") < -TOLERANCE_EMU)
    )
    return (F.col("text") != "") & outside


def slide_facts(shapes: DataFrame) -> DataFrame:
    """One row per slide from its shapes ``(deck_id, slide_no, shape_no, x, y, cx, cy, text, dark, has_img, has_tbl)``.

    The body is one text per slide because a phrase may run over two shapes.
    """
    has_text = F.col("text") != ""
    texts = F.array_sort(F.collect_list(F.when(has_text, F.struct("shape_no", "text"))))
    return (
        shapes.groupBy("deck_id", "slide_no")
        .agg(
            F.count_if(overflows()).alias("n_overflow"),
            F.bool_or("dark").alias("dark"),
            F.bool_or("has_img").alias("has_img"),
            F.bool_or("has_tbl").alias("has_tbl"),
            F.count_if(F.col("y") / EMU_PER_INCH > BODY_TOP_INCHES).alias("body_shapes"),
            F.min(F.when(has_text, F.col("y") / EMU_PER_INCH)).alias("min_top"),
            F.max(F.when(has_text, (F.col("y") + F.col("cy")) / EMU_PER_INCH)).alias("max_bottom"),
            texts.alias("_texts"),
        )
        .withColumn("body", F.array_join(F.col("_texts.text"), " "))
        .withColumn("chars", F.length(F.trim("body")))
        .drop("_texts")
    )


def audit_slides(facts: DataFrame) -> DataFrame:
    """Add ``meta_hit`` and ``density``: sparse, empty_lower_half or null.

    First, last and quoted slides are not tested for density; the lower half is only looked at
    when the slide is not sparse.
    """
    ends = facts.groupBy("deck_id").agg(F.min("slide_no").alias("_first"), F.max("slide_no").alias("_last"))
    least = F.when(F.col("dark"), MIN_CHARS["dark"]).otherwise(MIN_CHARS["light"])
    pictured = F.col("has_img") | F.col("has_tbl")
    exempt = (
        (F.col("slide_no") == F.col("_first"))
        | (F.col("slide_no") == F.col("_last"))
        | F.contains("body", F.lit("“"))
    )
    sparse = (F.col("chars") < least) & ~(pictured | (F.col("body_shapes") >= BODY_SHAPES))
    hollow = (
        ~F.col("dark") & ~pictured
        & (F.col("max_bottom") < LOW_EDGE_INCHES) & (F.col("min_top") < HIGH_START_INCHES)
    )
    return (
        facts.join(ends, "deck_id")
        .withColumns(
            {
                "meta_hit": meta_hit(F.col("body")),
                "density": F.when(exempt, F.lit(None)).when(sparse, "sparse").when(hollow, "empty_lower_half"),
            }
        )
        .drop("_first", "_last")
    )


# Which files of a deck are pictures, and which are charts.
MEDIA_FOLDER = "ppt/media/"
PICTURE_FILE = r"(?i)\.(png|jpg|jpeg|gif|emf)$"
CHART_FILE = r"^ppt/charts/chart\d+\.xml$"


def media_counts(files: DataFrame) -> DataFrame:
    """``images`` (pictures), ``n_media`` and ``n_charts`` of every deck from its ``files(deck_id, name)``."""
    name = F.col("name")
    media = F.startswith(name, F.lit(MEDIA_FOLDER))
    kinds = {"images": media & name.rlike(PICTURE_FILE), "n_media": media, "n_charts": name.rlike(CHART_FILE)}
    # A name stands for one file, however often it is listed.
    return files.select("deck_id", "name").distinct().groupBy("deck_id").agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])


def deck_verdicts(
    audited: DataFrame,
    min_slides: int = MIN_SLIDES,
    lenient: bool = False,
    required_images: int = 0,
    files: DataFrame | None = None,
) -> DataFrame:
    """Per deck the number of hard problems and warnings, and whether it passes.

    ``images`` counts the picture files of the deck; without ``files`` a deck has none.
    """
    pages = audited.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("n_slides"),
        F.count_if(F.col("n_overflow") > 0).alias("overflow_slides"),
        F.count_if(F.col("meta_hit").isNotNull()).alias("meta_slides"),
        F.count_if(F.col("density").isNotNull()).alias("thin_slides"),
    )
    if files is None:
        pages = pages.withColumn("images", F.lit(0).cast("bigint"))
    else:
        pages = pages.join(media_counts(files).select("deck_id", "images"), "deck_id", "left").fillna(0, ["images"])
    hard = (
        F.col("overflow_slides")
        + F.col("meta_slides")
        + (F.lit(0) if lenient else F.col("thin_slides"))
        + (F.col("n_slides") < min_slides).cast("int")
        + (F.col("images") < required_images).cast("int")
    )
    return pages.withColumns({"hard_problems": hard, "passes": hard == 0})


def text_stats(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Characters per slide without the cover (which counts when it is the only slide), slides with a
    table, and how many charts and media files a deck has."""
    cover = facts.groupBy("deck_id").agg(
        F.min("slide_no").alias("_first"), F.count(F.lit(1)).alias("n_slides")
    )
    joined = facts.join(cover, "deck_id")
    counted = F.when((F.col("slide_no") != F.col("_first")) | (F.col("n_slides") == 1), F.col("chars"))
    stats = joined.groupBy("deck_id").agg(
        F.max("n_slides").alias("n_slides"),
        F.min(counted).alias("min_chars"),
        F.max(counted).alias("max_chars"),
        F.count_if("has_tbl").alias("table_slides"),
    )
    counts = media_counts(files).select("deck_id", "n_media", "n_charts")
    return stats.join(counts, "deck_id", "left").fillna(0, ["n_media", "n_charts"])


# Least items per deck type and field for a deck of full length.
CONTENT_MINIMUMS = {
    "explainer": {"sections": 6},
    "howto": {"steps": 5, "overview": 3},
    "review": {"options": 3, "summary": 3},
    "interview": {"themes": 4, "takeaways": 3, "qa": 5},
    "news": {"angles": 4, "what": 3},
    "listicle": {"items": 6},
    "story": {"phases": 4, "background": 3},
    "talk": {"arguments": 4, "thesis": 3},
}


def content_shortfalls(contents: DataFrame) -> DataFrame:
    """Rows ``(deck_id, type, field, n_items, minimum)`` for fields below their minimum."""
    entries = []
    for deck_type, fields in CONTENT_MINIMUMS.items():
        pairs = [F.lit(v) for item in fields.items() for v in item]
        entries += [F.lit(deck_type), F.create_map(*pairs)]
    rules = F.create_map(*entries)[F.col("type")]
    return (
        contents.select("deck_id", "type", "sizes", F.explode(rules).alias("field", "minimum"))
        .withColumn("n_items", F.coalesce(F.col("sizes")[F.col("field")], F.lit(0)))
        .where("n_items < minimum")
        .drop("sizes")
    )


def rebuild_list(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Decks without a stored fingerprint equal to the wanted one."""
    return wanted.join(stored, ["deck_id", "v2_fingerprint"], "left_anti")


# --- figure manifests -----------------------------------------------------------------------

STATUSES = ("verified", "unverified", "dropped")


def audit_figures(figures: DataFrame) -> DataFrame:
    """Figures with the names of the broken rules and the status after the downgrade.

    Needs ``manifest_id, figure_id, kind, verification_status, png, pdf, svg, drop_reason,
    n_atom_refs, has_data``. A figure that breaks a rule becomes ``dropped``.
    """
    key = ["manifest_id", "figure_id"]
    repeats = figures.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    status = F.col("verification_status")
    dropped = status.eqNullSafe(F.lit("dropped"))
    redrawn = F.col("kind").eqNullSafe(F.lit("redrawn"))
    drawn = status.eqNullSafe(F.lit("verified")) & redrawn
    asset = F.coalesce("png", "pdf", "svg").isNotNull()
    rules = {
        "unique_id": F.col("_copies") == 1,
        "known_status": F.coalesce(status.isin(*STATUSES), F.lit(False)),
        "png_iff_kept": F.col("png").isNotNull().eqNullSafe(~dropped),
        "vectors_iff_verified_redrawn": F.col("pdf").isNotNull().eqNullSafe(drawn)
        & F.col("svg").isNotNull().eqNullSafe(drawn),
        "reason_iff_dropped": F.col("drop_reason").isNotNull().eqNullSafe(dropped),
        "redrawn_has_atoms": ~redrawn | (F.coalesce("n_atom_refs", F.lit(0)) > 0),
        "verified_redrawn_has_data": ~drawn | F.coalesce("has_data", F.lit(False)),
        "dropped_has_no_asset": ~(dropped & asset),
    }
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()]))
    return (
        figures.join(repeats, key)
        .withColumn("broken_rules", F.array_join(broken, ","))
        .withColumn(
            "final_status", F.when(F.col("broken_rules") != "", "dropped").otherwise(status)
        )
        .drop("_copies")
    )


def low_resolution(status: Column, dpi: Column, least: int = 300) -> Column:
    """A figure whose raster is too coarse is not verified."""
    return F.when((dpi < least) & (status == "verified"), "unverified").otherwise(status)


def manifest_summary(figures: DataFrame) -> DataFrame:
    """Summary of a manifest recomputed from its figures."""
    status, kind = F.col("verification_status"), F.col("kind")
    return figures.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s) for s in STATUSES],
        F.count_if(kind == "redrawn").alias("redrawn"),
        F.count_if(kind == "keyframe").alias("keyframes"),
    )


def audit_summaries(stated: DataFrame, figures: DataFrame) -> DataFrame:
    """Stated summaries against their figures: total, status sum and kind sum."""
    actual = figures.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("_figures"))
    return stated.join(actual, "manifest_id", "left").select(
        "manifest_id",
        (F.col("total") == F.coalesce("_figures", F.lit(0))).alias("total_ok"),
        (F.col("verified") + F.col("unverified") + F.col("dropped") == F.col("total")).alias("status_ok"),
        (F.col("redrawn") + F.col("keyframes") == F.col("total")).alias("kind_ok"),
    )


def review_flags(summary: DataFrame, limit: float = 0.15) -> DataFrame:
    """Share of unverified figures, the review flag and the targets of the status mix."""
    share = {s: F.try_divide(s, "total") for s in STATUSES}
    return summary.withColumns(
        {
            "unverified_share": share["unverified"],
            "needs_review": F.coalesce(share["unverified"] > limit, F.lit(False)),
            "mix_on_target": F.coalesce(
                (share["verified"] >= 0.60) & (share["unverified"] <= 0.15) & (share["dropped"] <= 0.25),
                F.lit(False),
            ),
        }
    )


# --- extraction accuracy --------------------------------------------------------------------


def point_errors(truth: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """Mean absolute and relative error of chart points ``(group, point, value)``."""
    gap = F.abs(F.col("found") - F.col("value"))
    return (
        truth.join(found.withColumnRenamed("value", "found"), [group, "point"])
        .groupBy(group)
        .agg(
            F.avg(gap).alias("mae"),
            F.avg(F.when(F.col("value") != 0, gap / F.abs("value"))).alias("mape"),
        )
    )


def cell_scores(truth: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """Precision, recall and F1 of table cells ``(group, cell, text)`` matched by place and text."""
    both = truth.withColumn("_t", F.lit(1)).join(
        found.withColumn("_f", F.lit(1)), [group, "cell", "text"], "full_outer"
    )
    hit = F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull())
    counts = both.groupBy(group).agg(hit.alias("hits"), F.count("_t").alias("_truth"), F.count("_f").alias("_found"))
    return counts.select(
        group,
        "hits",
        F.try_divide("hits", "_found").alias("precision"),
        F.try_divide("hits", "_truth").alias("recall"),
        F.try_divide(2 * F.col("hits"), F.col("_truth") + F.col("_found")).alias("f1"),
    )


def latex_distance(truth: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """Mean normalised edit distance of formulas ``(group, formula, latex)``."""
    return (
        truth.join(found.withColumnRenamed("latex", "_found"), [group, "formula"])
        .groupBy(group)
        .agg(F.avg(edit_share(F.col("latex"), F.col("_found"))).alias("edit_distance"))
    )
