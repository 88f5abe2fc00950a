"""Deck content: bundles, outlines, pages, counts (A8, A9, A14, G5-G10, U3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.text import clip_words
from cuesheet.operators.joins import nearest
from cuesheet.operators.ranking import DECK_CAPS, LISTICLE_DEEP_CAP, top_k
from cuesheet.ordering import TIME_SLOT_SEC, ord_slot, position, position_in_groups, time_slot
from cuesheet.session import stored

# --- resource bundles -----------------------------------------------------------------------


def numbered_slides(slides: DataFrame, width: float = TIME_SLOT_SEC) -> DataFrame:
    """Selected frames with ``snapshot``, their index in the recording."""
    order = [F.col("timestamp_sec"), F.col("ord")]
    return position(slides, ["video_id"], order, time_slot("timestamp_sec", width), "snapshot")


def bundle_items(slides: DataFrame, figures: DataFrame, width: float = TIME_SLOT_SEC) -> DataFrame:
    """All parts of the resource bundles, one row per label, formula or chart.

    A bundle is kept as rows ``(video_id, part, ord, …)`` rather than one row of arrays, which
    for a long recording would have to be built in one task. Keyframes and figures without
    data are left out. ``slides`` needs ``snapshot`` (see ``numbered_slides``).
    """
    # Both are read several times.
    slides = stored(slides.select("video_id", "snapshot", "timestamp_sec", "frame_type", "summary_hint"))
    labels = slides.select(
        "video_id", F.lit("figureLabels").alias("part"), F.col("snapshot").alias("ord"), "snapshot",
        F.col("timestamp_sec").alias("t"), F.col("frame_type").alias("kind"), F.col("summary_hint").alias("content"),
    )
    has_latex = (F.col("kind") == "equation") & F.col("latex").isNotNull()
    has_struct = F.coalesce(~F.col("struct").isin("", "{}", "[]", "null"), F.lit(False))
    part = F.when(has_latex, "formulas").when(has_struct, "charts")
    live = stored(figures.where("kind <> 'keyframe'").withColumn("part", part).where("part is not null"))
    placed = nearest(
        live, slides.select("video_id", "snapshot", F.col("timestamp_sec").alias("_at")), "_at", "snapshot", "snapshot", width=width
    )
    data = placed.select(
        "video_id", "part", "ord", "snapshot", F.col("timestamp_sec").alias("t"), "kind",
        F.when(F.col("part") == "formulas", F.col("latex")).otherwise(F.col("struct")).alias("content"),
        "figure_id", "confidence", "verification_status",
    )
    return labels.unionByName(data, allowMissingColumns=True)


def bundle_headers(videos: DataFrame, items: DataFrame) -> DataFrame:
    """One row per video, also for an empty bundle, with the size of each part."""
    sizes = items.groupBy("video_id").agg(
        *[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("figureLabels", "formulas", "charts")]
    )
    names = [c for c in sizes.columns if c != "video_id"]
    return videos.join(sizes, "video_id", "left").fillna(0, names)


def book_segments(segments: DataFrame) -> DataFrame:
    """Planned segments of a book renumbered from 0 in order. Needs ``collection_id, ord``."""
    return position(segments, ["collection_id"], [F.col("ord")], ord_slot("ord"), "index")


PAGE_SEGMENTS = 1000


def transcripts(segments: DataFrame, page_segments: int = PAGE_SEGMENTS) -> DataFrame:
    """Non-empty texts of a book joined by blank lines, in pages of many segments.

    Joining the pages of a book by a blank line gives its whole transcript; a usual book has
    one page. Pages keep the text of a huge book off a single row.
    """
    filled = segments.where(F.col("text") != "")
    numbered = position(filled, ["collection_id"], [F.col("ord")], ord_slot("ord"), "_pos")
    texts = F.array_sort(F.collect_list(F.struct("_pos", "text")))
    return (
        numbered.groupBy("collection_id", F.floor(F.col("_pos") / page_segments).alias("page"))
        .agg(texts.alias("_t"))
        .select("collection_id", "page", F.array_join(F.col("_t.text"), "\n\n").alias("transcript"))
    )


def book_formulas(pairs: DataFrame) -> DataFrame:
    """Formulas of the figures planned for a book's segments."""
    return pairs.where("kind = 'equation' and latex <> ''")


def merge_assets(charts: DataFrame, formulas: DataFrame) -> DataFrame:
    """Chart and formula assets in one table; a column one side lacks is null."""
    return charts.unionByName(formulas, allowMissingColumns=True)


# --- outlines -------------------------------------------------------------------------------

# The steps of each recipe as (layout, heading, field, rule, cap). Rules: always;
# if (the field is given); each (a slide per item); fours (a slide per four items); many (the
# field has four or more items); sections (each section with what it holds); or_sections (always,
# made of the first sections where the field is not given).
RECIPES = {
    "explainer": [
        ("title", "EXPLAINER", "", "always", 1),
        ("keyPoints", "Overview", "overview", "or_sections", 4),
        ("agenda", "Roadmap", "sections", "many", 1),
        ("conceptDeep", "Section", "sections", "sections", 8),
        ("comparisonTable", "Compare", "compare", "if", 1),
        ("kpis", "By the numbers", "metrics", "if", 1),
        ("keyPoints", "Essence", "essence", "or_sections", 4),
        ("qna", "Go deeper", "curiosity", "if", 1),
        ("closingCTA", "Close", "actions", "always", 1),
    ],
    "howto": [
        ("title", "HOW-TO", "", "always", 1),
        ("keyPoints", "Overview", "overview", "always", 1),
        ("keyPoints", "Prerequisites", "prereq", "if", 1),
        ("processSteps", "Steps", "steps", "always", 1),
        ("conceptDeep", "STEP", "steps", "each", 8),
        ("comparisonTable", "Options", "tools", "if", 1),
        ("twoColumn", "Tips", "pitfalls", "if", 1),
        ("keyPoints", "Troubleshooting", "troubleshoot", "if", 1),
        ("kpis", "Results", "metrics", "if", 1),
        ("closingCTA", "Close", "actions", "always", 1),
    ],
    "review": [
        ("title", "REVIEW", "", "always", 1),
        ("keyPoints", "Verdict", "summary", "always", 1),
        ("keyPoints", "Criteria", "criteria", "if", 1),
        ("comparisonTable", "Spec", "table", "if", 1),
        ("conceptDeep", "Option", "options", "each", 6),
        ("twoColumn", "Pros & Cons", "pros", "if", 1),
        ("kpis", "Scores", "scores", "if", 1),
        ("keyPoints", "Who for", "useCases", "if", 1),
        ("quote", "Quote", "quote", "if", 1),
        ("closingCTA", "Close", "recommend", "always", 1),
    ],
    "interview": [
        ("title", "CONVERSATION", "", "always", 1),
        ("keyPoints", "Takeaways", "takeaways", "always", 1),
        ("keyPoints", "Context", "speaker", "if", 1),
        ("conceptDeep", "Theme", "themes", "each", 6),
        ("qna", "Q&A", "qa", "fours", 1),
        ("quote", "Quote", "quote", "if", 1),
        ("keyPoints", "So what", "implications", "if", 1),
        ("closingCTA", "Close", "actions", "always", 1),
    ],
    "news": [
        ("title", "BRIEFING", "", "always", 1),
        ("keyPoints", "What happened", "what", "always", 1),
        ("kpis", "By the numbers", "metrics", "if", 1),
        ("twoColumn", "Why", "causes", "if", 1),
        ("conceptDeep", "Angle", "angles", "each", 6),
        ("timeline", "Timeline", "timeline", "if", 1),
        ("twoColumn", "Reactions", "reactions", "if", 1),
        ("keyPoints", "Outlook", "outlook", "if", 1),
        ("closingCTA", "Close", "watch", "always", 1),
    ],
    "listicle": [
        ("title", "RANKING", "", "always", 1),
        ("keyPoints", "Criteria", "criteria", "if", 1),
        ("listRanked", "Ranking", "items", "always", 1),
        ("conceptDeep", "Item", "items", "each", 8),
        ("comparisonTable", "Head-to-head", "topCompare", "if", 1),
        ("closingCTA", "Close", "actions", "always", 1),
    ],
    "story": [
        ("title", "CASE STUDY", "", "always", 1),
        ("keyPoints", "Context", "background", "always", 1),
        ("timeline", "Arc", "timeline", "if", 1),
        ("conceptDeep", "Phase", "phases", "each", 6),
        ("twoColumn", "Lessons", "turning", "if", 1),
        ("quote", "Quote", "quote", "if", 1),
        ("kpis", "Outcome", "metrics", "if", 1),
        ("keyPoints", "Lessons", "lessons", "if", 1),
        ("closingCTA", "Close", "actions", "always", 1),
    ],
    "talk": [
        ("title", "KEYNOTE", "", "always", 1),
        ("keyPoints", "Thesis", "thesis", "always", 1),
        ("kpis", "Evidence", "metrics", "if", 1),
        ("conceptDeep", "Argument", "arguments", "each", 6),
        ("comparisonTable", "Compare", "compare", "if", 1),
        ("quote", "Quote", "quote", "if", 1),
        ("processSteps", "How", "plan", "if", 1),
        ("keyPoints", "Impact", "impact", "if", 1),
        ("closingCTA", "Close", "asks", "always", 1),
    ],
}


# Most entries of a list that a deck is made of. A ranking of ten shows eight.
LIST_CAPS = {
    "sections": 8,
    "steps": 8,
    "options": 6,
    "themes": 6,
    "angles": 6,
    "items": LISTICLE_DEEP_CAP,
    "phases": 6,
    "arguments": 6,
}


def _recipe_steps(deck_type: Column) -> Column:
    def step(layout: str, heading: str, field: str, rule: str, cap: int) -> Column:
        return F.struct(
            F.lit(layout).alias("layout"), F.lit(heading).alias("heading"), F.lit(field).alias("field"),
            F.lit(rule).alias("rule"), F.lit(cap).alias("cap"),
        )

    entries = []
    for name, steps in RECIPES.items():
        entries += [F.lit(name), F.array(*[step(*s) for s in steps])]
    return F.create_map(*entries)[deck_type]


def outline(contents: DataFrame) -> DataFrame:
    """Slides of every deck: ``(deck_id, position, layout, heading, item, n_items)``.

    ``contents`` needs ``deck_id, type``, ``sizes map<string,int>`` (a field that is not given
    has no key) and ``sections array<struct<compare:boolean, examples:boolean>>``. All slides
    of a deck come from its own row, so nothing is shuffled.
    """
    sizes = F.col("sizes")

    # Lists are cut before anything is made of them; the pairs of one slide are four at most.
    caps = F.create_map(*[F.lit(v) for item in LIST_CAPS.items() for v in item])

    def size_of(step: Column) -> Column:
        given = F.coalesce(sizes[step["field"]], F.lit(0))
        borrowed = F.least(step["cap"], F.coalesce(sizes["sections"], F.lit(0)))
        lacking = (step["rule"] == "or_sections") & sizes[step["field"]].isNull()
        return F.when(lacking, borrowed).otherwise(F.least(given, F.coalesce(caps[step["field"]], given)))

    def repeats(step: Column) -> Column:
        return (
            F.when(step["rule"].isin("always", "or_sections"), 1)
            .when(step["rule"] == "if", sizes[step["field"]].isNotNull().cast("int"))
            .when(step["rule"] == "many", (size_of(step) >= 4).cast("int"))
            .when(step["rule"] == "each", F.least(step["cap"], size_of(step)))
            .when(step["rule"] == "fours", F.ceil(size_of(step) / 4).cast("int"))
            .otherwise(0)
        )

    def slide(layout: Column, step: Column, item: Column) -> Column:
        n = size_of(step)
        own = F.when(step["rule"] == "fours", F.least(F.lit(4), n - (item - 1) * 4)).otherwise(n)
        return F.struct(
            layout.alias("layout"), step["heading"].alias("heading"), item.cast("int").alias("item"), own.cast("int").alias("n_items")
        )

    def plain(step: Column) -> Column:
        n = repeats(step)
        return F.transform(
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
            lambda k: slide(step["layout"], step, k),
        )

    def by_section(step: Column) -> Column:
        held = F.slice("sections", F.lit(1), step["cap"])
        return F.flatten(
            F.transform(
                held,
                lambda s, i: F.when(
                    s["compare"],
                    F.array(slide(step["layout"], step, i + 1), slide(F.lit("comparisonTable"), step, i + 1)),
                )
                .when(
                    s["examples"],
                    F.array(slide(step["layout"], step, i + 1), slide(F.lit("keyPoints"), step, i + 1)),
                )
                .otherwise(F.array(slide(step["layout"], step, i + 1))),
            )
        )

    slides = F.flatten(
        F.transform(
            _recipe_steps(F.col("type")),
            lambda step: F.when(step["rule"] == "sections", by_section(step)).otherwise(plain(step)),
        )
    )
    return contents.select("deck_id", F.posexplode(slides).alias("position", "_s")).select(
        "deck_id", "position", "_s.*"
    )


def with_figure_slides(slides: DataFrame, figures: DataFrame) -> DataFrame:
    """Resolved figures placed before the closing slide of their deck, positions renumbered.

    ``figures(deck_id, ref_ord, slide_kind)``; ``ref_ord`` orders the references of a deck.
    """
    # Stored, for they are made of several tables and read several times.
    figures = stored(figures.select("deck_id", "ref_ord", "slide_kind"))
    numbered = position_in_groups(figures, ["deck_id"], [F.col("ref_ord")], ord_slot("ref_ord"), "_n")
    layout = F.when(F.col("slide_kind") == "table", "figureTableSlide").otherwise("figureSlide").alias("layout")
    lines = slides.select("deck_id", "position", "layout").unionByName(numbered.select("deck_id", layout, "_n"), allowMissingColumns=True)
    counted = slides.select("deck_id", "position").unionByName(figures.select("deck_id", F.lit(1).alias("_one")), allowMissingColumns=True)
    ends = counted.groupBy("deck_id").agg(F.max("position").alias("_last"), F.sum("_one").alias("_figures"))
    place = (
        F.when(F.col("_n").isNotNull(), F.col("_last") + F.col("_n"))
        .when(F.col("position") == F.col("_last"), F.col("position") + F.coalesce("_figures", F.lit(0)))
        .otherwise(F.col("position"))
    )
    # Figures of a deck without slides have no place.
    return lines.join(ends, "deck_id").where("_last is not null").select("deck_id", place.cast("int").alias("position"), "layout")


def deck_counts(sections: DataFrame, pages: DataFrame, figures: DataFrame) -> DataFrame:
    """Topics, sections, native tables, diagrams and slides of a deck.

    ``sections(deck_id, chapter)``: a chapter without sections has no row. Decks of fewer than
    three chapters have no roadmap, map and essence slides.
    """
    text = sections.groupBy("deck_id").agg(
        F.countDistinct("chapter").alias("topics"), F.count(F.lit(1)).alias("sections")
    )
    body = pages.groupBy("deck_id").agg(F.count(F.lit(1)).alias("pages"))
    drawn = figures.groupBy("deck_id").agg(
        F.count_if(
            (F.col("kind") == "table") & (F.col("n_headers") > 0) & (F.col("n_rows") > 0)
        ).alias("tables"),
        F.count_if(F.col("kind").isin("diagram", "chart") & F.col("rendered")).alias("diagrams"),
    )
    few = F.when(F.col("topics") < 3, 0).otherwise(3)
    return (
        text.join(body, "deck_id", "left").join(drawn, "deck_id", "left")
        .fillna(0, ["pages", "tables", "diagrams"])
        .withColumn(
            "total_slides", F.lit(2) + few + F.col("pages") + F.col("tables") + F.col("diagrams")
        )
    )


# Fixed value: sections from which a deck shows a timeline.
TIMELINE_SECTIONS = 3


def narrative_arc(videos: DataFrame, sections: DataFrame, figures: DataFrame, atoms: DataFrame) -> DataFrame:
    """Steps of a deck told along its recording, in order.

    Cover; timeline from three sections on; per section an intro, key points from two on, and its
    figures; up to four highlights; summary; a note when relevance is low.
    ``videos(video_id, relevance_pct)``, ``sections(video_id, index, n_key_points)``,
    ``figures(video_id, index, ord)``, ``atoms(video_id, ord)`` already picked.
    """

    def step(source: DataFrame, part: int, name: str, index: Column | None = None, order: Column | None = None, minor: int = 0) -> DataFrame:
        return source.select(
            "video_id", F.lit(part).alias("part"),
            (F.lit(0) if index is None else index).cast("bigint").alias("section"),
            F.lit(minor).alias("minor"),
            (F.lit(0) if order is None else order).cast("bigint").alias("item"),
            F.lit(name).alias("step"),
        )

    many = sections.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= TIMELINE_SECTIONS)
    index = F.col("index")
    branches = [
        step(videos, 0, "cover"),
        step(many, 1, "timeline"),
        step(sections, 2, "section_intro", index),
        step(sections.where("n_key_points >= 2"), 2, "key_points", index, minor=1),
        step(figures, 2, "figure", index, F.col("ord"), minor=2),
        step(atoms, 3, "atom_highlight", order=F.col("ord")),
        step(videos, 4, "summary"),
        step(videos.where("relevance_pct < 30"), 5, "low_relevance"),
    ]
    arc = branches[0]
    for branch in branches[1:]:
        arc = arc.unionByName(branch)
    order = [F.col(c) for c in ("part", "section", "minor", "item")]
    slot = F.col("part") * F.lit(1 << 40) + F.col("section")
    return position(arc, ["video_id"], order, slot, "position").select("video_id", "position", "step", "section")


CONCEPTS_PER_PAGE = 4
CONCEPT_SPLIT = 12


def concept_pages(concepts: DataFrame) -> DataFrame:
    """Page of each concept: four a page when a recording has more than twelve, else one page."""
    counted = position(concepts, ["video_id"], [F.col("ord")], ord_slot("ord"), "_pos", "_n")
    return counted.withColumn(
        "page",
        F.when(F.col("_n") > CONCEPT_SPLIT, F.floor(F.col("_pos") / CONCEPTS_PER_PAGE)).otherwise(0),
    ).drop("_pos", "_n")


# --- fields of layouts, questions of a book -------------------------------------------------

# Most items in the body of a layout.
LAYOUT_CAPS = {"key_points": 5, "summary": 6}


def layout_fields(slides: DataFrame, summaries: DataFrame) -> DataFrame:
    """``slides(video_id, position, layout, n, caption)`` with the ``title`` and the ``items`` of their body.

    Layouts draw on fields of the video's summary (see ``parse_summaries``): ``n`` is the number of the
    section or atom, by position. A field that is absent gives a null title or no items.
    """
    layout, n = F.col("layout"), F.col("n")
    fields = summaries.select("video_id", "core", "analysis", "segments")
    section, atom = F.get("segments.sections", n), F.get("segments.atoms", n)
    points = F.transform(section["key_points"], lambda p: p["text"])
    terms = F.transform("analysis.key_concepts", lambda c: c["term"])
    title = (
        F.when(layout.isin("cover", "timeline", "summary"), F.col("core.one_liner"))
        .when(layout.isin("section_intro", "key_points"), section["title"])
        .when(layout == "atom_highlight", atom["type"])
        .when(layout.isin("figure_full", "figure_caption"), F.col("caption"))
    )
    items = (
        F.when(layout == "cover", F.array("analysis.core_argument"))
        .when(layout == "section_intro", F.array(section["summary"]))
        .when(layout == "key_points", F.slice(points, 1, LAYOUT_CAPS["key_points"]))
        .when(layout == "atom_highlight", F.array(atom["text"]))
        .when(layout == "figure_caption", F.array("caption"))
        .when(layout == "timeline", F.transform("segments.sections", lambda s: s["title"]))
        .when(layout == "summary", F.slice(terms, 1, LAYOUT_CAPS["summary"]))
    )
    whole = F.coalesce(F.array_compact(items), F.array().cast("array<string>"))
    return slides.join(fields, "video_id", "left").select(*slides.columns, title.alias("title"), whole.alias("items"))


# Most characters of a question, of an answer, and of a title made a question; texts
# where there is nothing to ask about.
QUESTION_CHARS, ANSWER_CHARS, TOPIC_CHARS = 60, 90, 30
NO_TOPIC, NO_ANSWER = "주제", "핵심 개념을 더 탐구해보자."


def question_pool(sections: DataFrame, k: int = DECK_CAPS["qa"]) -> DataFrame:
    """First ``k`` questions of every book: ``(collection_id, rank, q, a)``.

    ``sections(collection_id, chapter, ord, chapter_title, narrative, qa array<struct<q,a>>)``. Pairs
    count when both texts are given, in the order of chapter, section and pair. A book without any asks about
    its first chapters, answered by the narrative of their first section.
    """
    asked = sections.select("collection_id", "chapter", "ord", F.posexplode("qa").alias("_no", "_p")).select(
        "collection_id", "chapter", "ord", "_no", F.trim("_p.q").alias("q"), F.trim("_p.a").alias("a")
    )
    own = top_k(asked.where("q <> '' and a <> ''"), ["collection_id"], [F.col("chapter"), F.col("ord"), F.col("_no")], k).select(
        "collection_id", "rank", clip_words(F.col("q"), QUESTION_CHARS).alias("q"), clip_words(F.col("a"), ANSWER_CHARS).alias("a")
    )
    first = sections.groupBy("collection_id", "chapter").agg(
        F.min_by(F.struct("chapter_title", "narrative"), "ord").alias("_s")
    )
    chapters = top_k(first, ["collection_id"], [F.col("chapter")], k)

    def given(text: Column, otherwise: str) -> Column:
        known = F.coalesce(F.trim(text), F.lit(""))
        return F.when(known == "", otherwise).otherwise(known)

    topics = chapters.select(
        "collection_id",
        "rank",
        F.concat(clip_words(given(F.col("_s.chapter_title"), NO_TOPIC), TOPIC_CHARS), F.lit("?")).alias("q"),
        clip_words(given(F.col("_s.narrative"), NO_ANSWER), ANSWER_CHARS).alias("a"),
    )
    return own.unionByName(topics.join(own.select("collection_id").distinct(), "collection_id", "left_anti"))
