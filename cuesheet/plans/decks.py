"""Queries over decks: bundles, outlines, pages, audits, manifests, collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.operators import audits, decks, generators, joins, ranking, topics
from cuesheet.operators.classify import DECK_TYPES
from cuesheet.operators.gates import relevance_path
from cuesheet.ordering import position, position_in_groups
from cuesheet.plans.bindings import _LINE, ctes, frames, recordings, sections, slides
from cuesheet.plans.frames import DAY
from cuesheet.plans.gating import RELEVANCE, relevance
from cuesheet.plans.registry import load, query

HOUR = 3600.0

# --- bundles --------------------------------------------------------------------------------

_BUNDLE = """, shots AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, ord) - 1 AS snapshot FROM slides WHERE is_slide),
figures AS (SELECT video_id, ord, timestamp_sec, CASE phash % 3 WHEN 0 THEN 'equation' WHEN 1 THEN 'keyframe' ELSE 'chart' END AS kind,
  CASE WHEN phash % 2 = 0 THEN 'x^' || phash END AS latex, CASE WHEN phash % 5 <> 0 THEN '{"a":1}' ELSE '{}' END AS struct
  FROM slides WHERE event_type IN ('error', 'purchase')),
parted AS (SELECT *, CASE WHEN kind = 'equation' AND latex IS NOT NULL THEN 'formulas' WHEN struct <> '{}' THEN 'charts' END AS part
  FROM figures WHERE kind <> 'keyframe'),
placed AS (SELECT p.video_id, p.part, p.ord, s.snapshot, p.kind, CASE WHEN p.part = 'formulas' THEN latex ELSE struct END AS content
  FROM parted p LEFT JOIN shots s ON s.video_id = p.video_id WHERE p.part IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY p.video_id, p.ord ORDER BY abs(s.timestamp_sec - p.timestamp_sec), s.snapshot) = 1),
items AS (SELECT video_id, 'figureLabels' AS part, snapshot AS ord, snapshot, event_type AS kind, 'note ' || ord AS content FROM shots
  UNION ALL SELECT * FROM placed)"""


def _bundle(spark, folder):
    every = slides(spark, folder)
    shots = decks.numbered_slides(
        every.where("is_slide").withColumns(
            {"frame_type": F.col("event_type"), "summary_hint": F.concat(F.lit("note "), F.col("ord").cast("string"))}
        ),
        HOUR,
    )
    k = F.col("phash")
    figures = every.where("event_type in ('error', 'purchase')").select(
        "video_id", "ord", "timestamp_sec",
        F.when(k % 3 == 0, "equation").when(k % 3 == 1, "keyframe").otherwise("chart").alias("kind"),
        F.when(k % 2 == 0, F.concat(F.lit("x^"), k.cast("string"))).alias("latex"),
        F.when(k % 5 != 0, '{"a":1}').otherwise("{}").alias("struct"),
        F.col("ord").cast("string").alias("figure_id"),
        F.lit(0.9).alias("confidence"),
        F.lit("pending").alias("verification_status"),
    )
    return decks.bundle_items(shots, figures, HOUR)


@query("a8_bundle_items", ctes("slides", _BUNDLE + " SELECT * FROM items"))
def a8(spark, folder):
    return _bundle(spark, folder).select("video_id", "part", "ord", "snapshot", "kind", "content")


@query(
    "a8_bundle_headers",
    ctes(
        "slides",
        _BUNDLE
        + """ SELECT c_custkey AS video_id, count(*) FILTER (part = 'figureLabels') AS "n_figureLabels",
  count(*) FILTER (part = 'formulas') AS n_formulas, count(*) FILTER (part = 'charts') AS n_charts
FROM customer LEFT JOIN items ON c_custkey = video_id GROUP BY c_custkey""",
    ),
)
def a8_headers(spark, folder):
    videos = load(spark, folder, "customer").select(F.col("c_custkey").alias("video_id"))
    return decks.bundle_headers(videos, _bundle(spark, folder))


# --- books: conversations -------------------------------------------------------------------


def _segments(spark, folder):
    return load(spark, folder, "conversations").select(
        F.col("conv_id").alias("collection_id"), F.col("turn").alias("ord"), "role",
        F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text")).alias("text"),
    )


@query(
    "a9_book_segments",
    """SELECT conv_id AS collection_id, turn AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index FROM conversations""",
)
def a9_segments(spark, folder):
    return decks.book_segments(_segments(spark, folder)).select("collection_id", "ord", "index")


@query(
    "a9_transcripts",
    """WITH filled AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE turn % 5 <> 4 AND text <> '')
       SELECT conv_id AS collection_id, pos // 1000 AS page, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM filled GROUP BY ALL""",
)
def a9_transcripts(spark, folder):
    return decks.transcripts(_segments(spark, folder))


_PLANNED = """, segments AS (SELECT video_id, index AS pos, from_sec, to_sec, CASE WHEN index * 11 % 100 >= 60 AND index % 2 = 0 THEN 'path1_figure' ELSE 'path2_text' END AS path FROM sections),
figures AS (SELECT video_id, ord, timestamp_sec, CASE WHEN phash % 2 = 0 THEN 'equation' ELSE 'chart' END AS kind, CASE WHEN phash % 3 > 0 THEN 'x^' || phash ELSE '' END AS latex FROM frames WHERE event_type = 'error'),
planned AS (SELECT s.video_id, s.pos, s.path, f.ord AS figure_ord, f.kind, f.latex FROM segments s LEFT JOIN figures f
  ON s.video_id = f.video_id AND s.path = 'path1_figure' AND f.timestamp_sec BETWEEN s.from_sec AND s.to_sec)"""


def _planned(spark, folder):
    segments = sections(spark, folder).select(
        "video_id", F.col("index").alias("pos"), "from_sec", "to_sec",
        relevance_path(F.col("index") * 11 % 100, F.col("index") % 2 == 0).alias("path"),
    )
    figures = frames(spark, folder).where("event_type = 'error'")
    return joins.segment_figures(segments, figures, DAY), figures


@query("j10_segment_figures", ctes("frames sections", _PLANNED + " SELECT video_id, pos, path, figure_ord FROM planned"))
def j10(spark, folder):
    return _planned(spark, folder)[0].select("video_id", "pos", "path", "figure_ord")


@query(
    "a9_book_formulas",
    ctes("frames sections", _PLANNED + " SELECT video_id, pos, figure_ord, latex FROM planned WHERE kind = 'equation' AND latex <> ''"),
)
def a9_formulas(spark, folder):
    pairs, figures = _planned(spark, folder)
    data = figures.select(
        "video_id", F.col("ord").alias("figure_ord"),
        F.when(F.col("phash") % 2 == 0, "equation").otherwise("chart").alias("kind"),
        F.when(F.col("phash") % 3 > 0, F.concat(F.lit("x^"), F.col("phash").cast("string"))).otherwise("").alias("latex"),
    )
    return decks.book_formulas(pairs.join(data, ["video_id", "figure_ord"])).select("video_id", "pos", "figure_ord", "latex")


# --- body pages -----------------------------------------------------------------------------

_BODY = r"""WITH base AS (
  SELECT conv_id AS deck_id, turn // 2 AS chapter, turn AS section, CASE WHEN turn % 5 = 4 THEN '' ELSE 'Section ' || turn END AS title, text AS narrative,
         CASE WHEN turn % 3 = 2 THEN [] ELSE list_filter(string_split(text, chr(10)), lambda x: x <> '') END AS atoms,
         list_filter(list_transform(string_split(regexp_replace(text, '([.!?…다])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 12) AS sentences
  FROM conversations),
src AS (SELECT *, CASE WHEN len(atoms) > 0 THEN atoms WHEN narrative <> '' THEN [narrative] ELSE [CASE WHEN title <> '' THEN title ELSE '—' END] END AS source FROM base),
shaped AS (SELECT *, CAST(greatest(1, ceil(len(source) / 6)) AS INTEGER) AS n_pages FROM src),
dealt AS (SELECT s.*, CAST(p AS INTEGER) AS page, CAST(ceil(len(source) / n_pages) AS BIGINT) AS per FROM shaped s, unnest(range(0, n_pages)) AS g(p)),
own AS (SELECT *, source[page * per + 1 : (page + 1) * per] AS mine FROM dealt),
body AS (
  SELECT deck_id, chapter, section, page, n_pages,
    list_reduce(list_transform(sentences, lambda s: [s]), lambda acc, s: CASE WHEN coalesce(list_sum(list_transform(acc, lambda a: length(a))), 0) < 150
      AND NOT list_contains(acc, s[1]) AND NOT list_contains(source, s[1]) THEN list_concat(acc, s) ELSE acc END, mine) AS bullets
  FROM own WHERE len(mine) > 0)
"""


def _body_sections(spark, folder):
    turn = F.col("turn")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return load(spark, folder, "conversations").select(
        F.col("conv_id").alias("deck_id"), F.floor(turn / 2).alias("chapter"), turn.alias("section"),
        F.when(turn % 5 == 4, "").otherwise(F.concat(F.lit("Section "), turn.cast("string"))).alias("title"),
        F.col("text").alias("narrative"),
        F.when(turn % 3 == 2, F.array().cast("array<string>")).otherwise(lines).alias("atoms"),
        text.narrative_sentences(F.col("text")).alias("sentences"),
    )


@query(
    "g5_body_pages",
    _BODY
    + "SELECT deck_id, section, page, n_pages, CAST(len(bullets) AS INTEGER) AS n_bullets, md5(array_to_string(bullets, '|')) AS digest FROM body",
)
def g5(spark, folder):
    return generators.body_pages(_body_sections(spark, folder)).select(
        "deck_id", "section", "page", "n_pages", F.size("bullets").alias("n_bullets"),
        F.md5(F.array_join("bullets", "|")).alias("digest"),
    )


@query(
    "a14_deck_counts",
    _BODY
    + """, t AS (SELECT deck_id, count(DISTINCT chapter) AS topics, count(*) AS sections FROM base GROUP BY deck_id),
b AS (SELECT deck_id, count(*) AS pages FROM body GROUP BY deck_id),
f AS (SELECT p.page_id % 100 AS deck_id, count(*) FILTER (page_id % 3 = 0 AND page_id % 4 > 0 AND page_id % 7 > 0) AS tables,
  count(*) FILTER (page_id % 3 > 0 AND page_id % 5 > 0) AS diagrams FROM pages p GROUP BY 1)
SELECT t.deck_id, topics, sections, coalesce(b.pages, 0) AS pages, coalesce(tables, 0) AS tables, coalesce(diagrams, 0) AS diagrams,
  2 + CASE WHEN topics < 3 THEN 0 ELSE 3 END + coalesce(b.pages, 0) + coalesce(tables, 0) + coalesce(diagrams, 0) AS total_slides
FROM t LEFT JOIN b ON t.deck_id = b.deck_id LEFT JOIN f ON t.deck_id = f.deck_id""",
)
def a14(spark, folder):
    body = _body_sections(spark, folder)
    n = F.col("page_id")
    figures = load(spark, folder, "pages").select(
        (n % 100).alias("deck_id"),
        F.when(n % 3 == 0, "table").when(n % 3 == 1, "diagram").otherwise("chart").alias("kind"),
        (n % 4).alias("n_headers"), (n % 7).alias("n_rows"), (n % 5 > 0).alias("rendered"),
    )
    return decks.deck_counts(body, generators.body_pages(body), figures)


@query(
    "g7_question_chunks",
    "SELECT conv_id, turn // 2 AS pos, turn // 2 // 4 AS page FROM conversations WHERE role = 'user'",
)
def g7(spark, folder):
    pairs = load(spark, folder, "conversations").where("role = 'user'").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("pos")
    )
    return generators.chunks(pairs, "pos", 4)


@query(
    "l4_recipe_caps",
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts, [8, 8, 6, 6, 6, 10, 6, 6][1 + doc_id % 8] AS cap FROM documents)
       SELECT doc_id, CAST(least(len(parts), cap) AS INTEGER) AS n_items, md5(array_to_string(parts[1:cap], '|')) AS digest FROM d""",
)
def l4(spark, folder):
    kind = F.array(*[F.lit(t) for t in DECK_TYPES])[(F.col("doc_id") % 8).cast("int")]
    kept = F.slice(F.split("text", "\n"), F.lit(1), ranking.recipe_cap(kind))
    return load(spark, folder, "documents").select("doc_id", kept.alias("k")).select(
        "doc_id", F.size("k").alias("n_items"), F.md5(F.array_join("k", "|")).alias("digest")
    )


@query(
    "l5_deck_caps",
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
       SELECT doc_id, CAST(least(len(parts), 6) AS INTEGER) AS table_rows, CAST(least(len(parts), 4) AS INTEGER) AS qa,
              CAST(least(len(parts), 5) AS INTEGER) AS roadmap, parts[least(len(parts), 6)] AS last_row FROM d""",
)
def l5(spark, folder):
    caps = ranking.DECK_CAPS
    parts = F.split("text", "\n")
    rows = ranking.first_items(parts, caps["table_rows"])
    return load(spark, folder, "documents").select(
        "doc_id", F.size(rows).alias("table_rows"), F.size(ranking.first_items(parts, caps["qa"])).alias("qa"),
        F.size(ranking.first_items(parts, caps["roadmap"])).alias("roadmap"), F.element_at(rows, -1).alias("last_row"),
    )


def _clip(column: str, size: int) -> str:
    """``column`` cut to ``size`` characters at a space beyond 60 %."""
    cut = f"left({column}, {size})"
    at = f"CASE WHEN contains({cut}, ' ') THEN length({cut}) - instr(reverse({cut}), ' ') ELSE -1 END"
    return f"CASE WHEN length({column}) <= {size} THEN {column} ELSE trim(CASE WHEN {at} > {size} * 0.6 THEN left({cut}, {at}) ELSE {cut} END) END"


# Turns as sections of a book, four to a chapter. Every fifth book has no pair with both texts.
@query(
    "l5_question_pool",
    f"""WITH sections AS (SELECT conv_id, turn // 4 AS chapter, turn % 4 AS ord, CASE WHEN conv_id % 2 = 0 THEN 'Chapter of ' || role || ' ' || turn // 4 ELSE ' ' END AS title,
    CASE WHEN turn % 3 <> 0 THEN text END AS narrative, text AS q1, CASE WHEN conv_id % 5 = 0 THEN '' ELSE role END AS a1, role || ' ' || turn AS q2, CASE WHEN conv_id % 5 <> 0 THEN text END AS a2 FROM conversations),
asked AS (SELECT conv_id, chapter, ord, 0 AS no, trim(q1) AS q, trim(a1) AS a FROM sections UNION ALL SELECT conv_id, chapter, ord, 1, trim(q2), trim(a2) FROM sections),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY chapter, ord, no) AS rank, q, a FROM asked WHERE q <> '' AND a <> '' QUALIFY rank <= 4),
firsts AS (SELECT conv_id, chapter, arg_min(struct_pack(t := title, n := narrative), ord) AS s FROM sections GROUP BY ALL),
topics AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY chapter) AS rank, CASE WHEN coalesce(trim(s.t), '') = '' THEN '주제' ELSE trim(s.t) END AS q,
    CASE WHEN coalesce(trim(s.n), '') = '' THEN '핵심 개념을 더 탐구해보자.' ELSE trim(s.n) END AS a FROM firsts WHERE conv_id NOT IN (SELECT conv_id FROM own) QUALIFY rank <= 4)
SELECT conv_id AS collection_id, CAST(rank AS INTEGER) AS rank, {_clip("q", 60)} AS q, {_clip("a", 90)} AS a FROM own
UNION ALL SELECT conv_id, CAST(rank AS INTEGER), ({_clip("q", 30)}) || '?', {_clip("a", 90)} FROM topics""",
)
def l5_questions(spark, folder):
    c, turn, even = F.col("conv_id"), F.col("turn"), F.col("conv_id") % 2 == 0
    pairs = F.array(
        F.struct(F.col("text").alias("q"), F.when(c % 5 == 0, "").otherwise(F.col("role")).alias("a")),
        F.struct(F.concat("role", F.lit(" "), turn.cast("string")).alias("q"), F.when(c % 5 != 0, F.col("text")).alias("a")),
    )
    chapter = F.floor(turn / 4)
    title = F.when(even, F.concat(F.lit("Chapter of "), "role", F.lit(" "), chapter.cast("string"))).otherwise(" ")
    sections = load(spark, folder, "conversations").select(
        c.alias("collection_id"), chapter.alias("chapter"), (turn % 4).alias("ord"), title.alias("chapter_title"),
        F.when(turn % 3 != 0, F.col("text")).alias("narrative"), pairs.alias("qa"),
    )
    return decks.question_pool(sections)


_LAYOUTS = ("cover", "section_intro", "key_points", "atom_highlight", "figure_full", "figure_caption", "timeline", "summary", "blank")


@query(
    "g6_layout_fields",
    f"""WITH slides AS (SELECT doc_id, CAST(p AS INTEGER) AS position, {list(_LAYOUTS)}[1 + p] AS layout, CAST(doc_id % 4 AS INTEGER) AS n, 'figure ' || p AS caption
    FROM documents, unnest(range(0, 9)) AS g(p)),
filled AS (SELECT *, CASE WHEN layout IN ('cover', 'timeline', 'summary') THEN 'about ' || lang WHEN layout IN ('section_intro', 'key_points') AND n < s.doc_id % 5 THEN 'part ' || n
      WHEN layout = 'atom_highlight' AND n < s.doc_id % 3 THEN 'fact' WHEN layout IN ('figure_full', 'figure_caption') THEN caption END AS title,
    CASE WHEN layout = 'cover' THEN CASE WHEN s.doc_id % 2 = 0 THEN ['so'] ELSE [] END WHEN layout = 'section_intro' AND n < s.doc_id % 5 AND n % 2 = 0 THEN ['says ' || n]
      WHEN layout = 'key_points' AND n < s.doc_id % 5 THEN list_transform(range(0, least(5, (s.doc_id + n) % 8)), lambda j: 'k' || j)
      WHEN layout = 'atom_highlight' AND n < s.doc_id % 3 THEN ['atom ' || n] WHEN layout = 'figure_caption' THEN [caption]
      WHEN layout = 'timeline' THEN list_transform(range(0, s.doc_id % 5), lambda j: 'part ' || j) WHEN layout = 'summary' THEN list_transform(range(0, least(6, s.doc_id % 9)), lambda j: 'c' || j) ELSE [] END AS items
  FROM slides s JOIN documents d ON d.doc_id = s.doc_id)
SELECT doc_id AS video_id, position, layout, title, CAST(len(items) AS INTEGER) AS n_items, array_to_string(items, '|') AS body FROM filled""",
)
def g6_layouts(spark, folder):
    d = F.col("doc_id")

    def listed(size, make):
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: i < size), make)

    def named(name):
        return lambda i: F.concat(F.lit(name), i.cast("string"))

    def section(i):
        points = listed((d + i) % 8, lambda j: F.struct(named("k")(j).alias("text")))
        return F.struct(named("part ")(i).alias("title"), F.when(i % 2 == 0, named("says ")(i)).alias("summary"), points.alias("key_points"))

    summaries = load(spark, folder, "documents").select(
        d.alias("video_id"), F.struct(F.concat(F.lit("about "), "lang").alias("one_liner")).alias("core"),
        F.struct(
            F.when(d % 2 == 0, "so").alias("core_argument"), listed(d % 9, lambda i: F.struct(named("c")(i).alias("term"))).alias("key_concepts")
        ).alias("analysis"),
        F.struct(
            listed(d % 5, section).alias("sections"),
            listed(d % 3, lambda i: F.struct(F.lit("fact").alias("type"), named("atom ")(i).alias("text"))).alias("atoms"),
        ).alias("segments"),
    )
    slides = load(spark, folder, "documents").select(
        d.alias("video_id"), (d % 4).cast("int").alias("n"), F.posexplode(F.array(*[F.lit(name) for name in _LAYOUTS])).alias("position", "layout")
    ).withColumn("caption", named("figure ")(F.col("position")))
    filled = decks.layout_fields(slides, summaries)
    return filled.select("video_id", "position", "layout", "title", F.size("items").alias("n_items"), F.array_join("items", "|").alias("body"))


@query(
    "l10_slide_file_order",
    """SELECT p_brand, 'ppt/slides/slide' || p_partkey || '.xml' AS file_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part""",
)
def l10(spark, folder):
    files = load(spark, folder, "part").select(
        "p_brand", F.concat(F.lit("ppt/slides/slide"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("file_name")
    )
    number = ranking.slide_number(F.col("file_name"))
    return position(files, ["p_brand"], [number], F.floor(number / 4096), "pos").select("p_brand", "file_name", "pos")


# --- outlines -------------------------------------------------------------------------------

_FIELDS = sorted({s[2] for steps in decks.RECIPES.values() for s in steps} - {""})
_TYPES = "[" + ", ".join(f"'{t}'" for t in DECK_TYPES) + "]"
# Written out, so that a wrong entry of the library's table shows.
_STEPS = """
  ('explainer', 0, 'title', 'EXPLAINER', '', 'always', 1),
  ('explainer', 1, 'keyPoints', 'Overview', 'overview', 'or_sections', 4),
  ('explainer', 2, 'agenda', 'Roadmap', 'sections', 'many', 1),
  ('explainer', 3, 'conceptDeep', 'Section', 'sections', 'sections', 8),
  ('explainer', 4, 'comparisonTable', 'Compare', 'compare', 'if', 1),
  ('explainer', 5, 'kpis', 'By the numbers', 'metrics', 'if', 1),
  ('explainer', 6, 'keyPoints', 'Essence', 'essence', 'or_sections', 4),
  ('explainer', 7, 'qna', 'Go deeper', 'curiosity', 'if', 1),
  ('explainer', 8, 'closingCTA', 'Close', 'actions', 'always', 1),
  ('howto', 0, 'title', 'HOW-TO', '', 'always', 1),
  ('howto', 1, 'keyPoints', 'Overview', 'overview', 'always', 1),
  ('howto', 2, 'keyPoints', 'Prerequisites', 'prereq', 'if', 1),
  ('howto', 3, 'processSteps', 'Steps', 'steps', 'always', 1),
  ('howto', 4, 'conceptDeep', 'STEP', 'steps', 'each', 8),
  ('howto', 5, 'comparisonTable', 'Options', 'tools', 'if', 1),
  ('howto', 6, 'twoColumn', 'Tips', 'pitfalls', 'if', 1),
  ('howto', 7, 'keyPoints', 'Troubleshooting', 'troubleshoot', 'if', 1),
  ('howto', 8, 'kpis', 'Results', 'metrics', 'if', 1),
  ('howto', 9, 'closingCTA', 'Close', 'actions', 'always', 1),
  ('review', 0, 'title', 'REVIEW', '', 'always', 1),
  ('review', 1, 'keyPoints', 'Verdict', 'summary', 'always', 1),
  ('review', 2, 'keyPoints', 'Criteria', 'criteria', 'if', 1),
  ('review', 3, 'comparisonTable', 'Spec', 'table', 'if', 1),
  ('review', 4, 'conceptDeep', 'Option', 'options', 'each', 6),
  ('review', 5, 'twoColumn', 'Pros & Cons', 'pros', 'if', 1),
  ('review', 6, 'kpis', 'Scores', 'scores', 'if', 1),
  ('review', 7, 'keyPoints', 'Who for', 'useCases', 'if', 1),
  ('review', 8, 'quote', 'Quote', 'quote', 'if', 1),
  ('review', 9, 'closingCTA', 'Close', 'recommend', 'always', 1),
  ('interview', 0, 'title', 'CONVERSATION', '', 'always', 1),
  ('interview', 1, 'keyPoints', 'Takeaways', 'takeaways', 'always', 1),
  ('interview', 2, 'keyPoints', 'Context', 'speaker', 'if', 1),
  ('interview', 3, 'conceptDeep', 'Theme', 'themes', 'each', 6),
  ('interview', 4, 'qna', 'Q&A', 'qa', 'fours', 1),
  ('interview', 5, 'quote', 'Quote', 'quote', 'if', 1),
  ('interview', 6, 'keyPoints', 'So what', 'implications', 'if', 1),
  ('interview', 7, 'closingCTA', 'Close', 'actions', 'always', 1),
  ('news', 0, 'title', 'BRIEFING', '', 'always', 1),
  ('news', 1, 'keyPoints', 'What happened', 'what', 'always', 1),
  ('news', 2, 'kpis', 'By the numbers', 'metrics', 'if', 1),
  ('news', 3, 'twoColumn', 'Why', 'causes', 'if', 1),
  ('news', 4, 'conceptDeep', 'Angle', 'angles', 'each', 6),
  ('news', 5, 'timeline', 'Timeline', 'timeline', 'if', 1),
  ('news', 6, 'twoColumn', 'Reactions', 'reactions', 'if', 1),
  ('news', 7, 'keyPoints', 'Outlook', 'outlook', 'if', 1),
  ('news', 8, 'closingCTA', 'Close', 'watch', 'always', 1),
  ('listicle', 0, 'title', 'RANKING', '', 'always', 1),
  ('listicle', 1, 'keyPoints', 'Criteria', 'criteria', 'if', 1),
  ('listicle', 2, 'listRanked', 'Ranking', 'items', 'always', 1),
  ('listicle', 3, 'conceptDeep', 'Item', 'items', 'each', 8),
  ('listicle', 4, 'comparisonTable', 'Head-to-head', 'topCompare', 'if', 1),
  ('listicle', 5, 'closingCTA', 'Close', 'actions', 'always', 1),
  ('story', 0, 'title', 'CASE STUDY', '', 'always', 1),
  ('story', 1, 'keyPoints', 'Context', 'background', 'always', 1),
  ('story', 2, 'timeline', 'Arc', 'timeline', 'if', 1),
  ('story', 3, 'conceptDeep', 'Phase', 'phases', 'each', 6),
  ('story', 4, 'twoColumn', 'Lessons', 'turning', 'if', 1),
  ('story', 5, 'quote', 'Quote', 'quote', 'if', 1),
  ('story', 6, 'kpis', 'Outcome', 'metrics', 'if', 1),
  ('story', 7, 'keyPoints', 'Lessons', 'lessons', 'if', 1),
  ('story', 8, 'closingCTA', 'Close', 'actions', 'always', 1),
  ('talk', 0, 'title', 'KEYNOTE', '', 'always', 1),
  ('talk', 1, 'keyPoints', 'Thesis', 'thesis', 'always', 1),
  ('talk', 2, 'kpis', 'Evidence', 'metrics', 'if', 1),
  ('talk', 3, 'conceptDeep', 'Argument', 'arguments', 'each', 6),
  ('talk', 4, 'comparisonTable', 'Compare', 'compare', 'if', 1),
  ('talk', 5, 'quote', 'Quote', 'quote', 'if', 1),
  ('talk', 6, 'processSteps', 'How', 'plan', 'if', 1),
  ('talk', 7, 'keyPoints', 'Impact', 'impact', 'if', 1),
  ('talk', 8, 'closingCTA', 'Close', 'asks', 'always', 1)"""
_CONTENT = f"""WITH fields(field, idx) AS (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(_FIELDS))}),
contents AS (SELECT doc_id AS deck_id, {_TYPES}[1 + doc_id % 8] AS type FROM documents),
sizes AS (SELECT deck_id, field, CAST((deck_id + idx) % 10 AS INTEGER) AS n FROM contents, fields WHERE (deck_id + idx) % 3 <> 0)"""


def contents(spark, folder):
    """A deck per document; which fields it has, and how many items, follows from its id."""
    d = F.col("doc_id")
    names = F.array(*[F.lit(f) for f in _FIELDS])
    pairs = F.filter(
        F.transform(names, lambda f, i: F.struct(f.alias("key"), ((d + i) % 10).cast("int").alias("value"), ((d + i) % 3 != 0).alias("given"))),
        lambda p: p["given"],
    )
    sizes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"], p["value"])))
    n = F.coalesce(F.col("sizes")["sections"], F.lit(0))
    held = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((i % 3 == 0).alias("compare"), (i % 3 == 1).alias("examples")),
    )
    return (
        load(spark, folder, "documents")
        .select(d.alias("deck_id"), F.array(*[F.lit(t) for t in DECK_TYPES])[(d % 8).cast("int")].alias("type"), sizes.alias("sizes"))
        .withColumn("sections", held)
    )


@query(
    "g6_recipe_outlines",
    _CONTENT
    + f""", steps(type, step, layout, heading, field, rule, cap) AS (VALUES {_STEPS}),
wide AS (SELECT c.deck_id, s.*, CAST(CASE WHEN rule = 'or_sections' AND z.n IS NULL THEN least(4, coalesce(m.n, 0))
    WHEN s.field IN ('sections', 'steps', 'items') THEN least(8, coalesce(z.n, 0)) WHEN s.field IN ('options', 'themes', 'angles', 'phases', 'arguments') THEN least(6, coalesce(z.n, 0))
    ELSE coalesce(z.n, 0) END AS INTEGER) AS n_items, CASE rule WHEN 'always' THEN 1 WHEN 'or_sections' THEN 1 WHEN 'if' THEN (z.n IS NOT NULL)::INT
    WHEN 'many' THEN (coalesce(z.n, 0) >= 4)::INT WHEN 'fours' THEN ceil(coalesce(z.n, 0) / 4)::INT ELSE least(cap, coalesce(z.n, 0)) END AS reps
  FROM contents c JOIN steps s ON s.type = c.type LEFT JOIN sizes z ON z.deck_id = c.deck_id AND z.field = s.field
  LEFT JOIN sizes m ON m.deck_id = c.deck_id AND m.field = 'sections'),
rows AS (SELECT deck_id, step, layout, heading, CASE WHEN rule = 'fours' THEN CAST(least(4, n_items - (k - 1) * 4) AS INTEGER) ELSE n_items END AS n_items, CAST(k AS INTEGER) AS item, 0 AS sub FROM wide, unnest(range(1, reps + 1)) AS g(k)
  UNION ALL
  SELECT deck_id, step, CASE WHEN (k - 1) % 3 = 0 THEN 'comparisonTable' ELSE 'keyPoints' END, heading, n_items, CAST(k AS INTEGER), 1
  FROM wide, unnest(range(1, reps + 1)) AS g(k) WHERE rule = 'sections' AND (k - 1) % 3 < 2)
SELECT deck_id, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY step, item, sub) - 1 AS INTEGER) AS position, layout, heading, item, n_items FROM rows""",
)
def g6(spark, folder):
    return decks.outline(contents(spark, folder))


_MINIMUMS = """
  ('explainer', 'sections', 6),
  ('howto', 'steps', 5),
  ('howto', 'overview', 3),
  ('review', 'options', 3),
  ('review', 'summary', 3),
  ('interview', 'themes', 4),
  ('interview', 'takeaways', 3),
  ('interview', 'qa', 5),
  ('news', 'angles', 4),
  ('news', 'what', 3),
  ('listicle', 'items', 6),
  ('story', 'phases', 4),
  ('story', 'background', 3),
  ('talk', 'arguments', 4),
  ('talk', 'thesis', 3)"""


@query(
    "v6_content_minimums",
    _CONTENT
    + f""", rules(type, field, minimum) AS (VALUES {_MINIMUMS})
SELECT c.deck_id, c.type, r.field, coalesce(z.n, 0) AS n_items, r.minimum FROM contents c JOIN rules r ON r.type = c.type
LEFT JOIN sizes z ON z.deck_id = c.deck_id AND z.field = r.field WHERE coalesce(z.n, 0) < r.minimum""",
)
def v6(spark, folder):
    return audits.content_shortfalls(contents(spark, folder))


_FIGURES = f"""WITH line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS ref_ord, 'f' || l_linenumber AS figure_id FROM lineitem),
assets AS (SELECT l_orderkey AS deck_id, figure_id, arg_max('a' || l_partkey, l_partkey * 1000 + l_suppkey) AS asset FROM line WHERE l_linestatus = 'F' GROUP BY ALL),
tables AS (SELECT l_orderkey AS deck_id, figure_id, arg_max(l_partkey % 3 > 0 AND l_suppkey % 2 > 0, l_partkey * 1000 + l_suppkey) AS usable FROM line WHERE l_discount > 0.05 GROUP BY ALL),
resolved AS (SELECT l.l_orderkey AS deck_id, l.ref_ord, l.figure_id, CASE WHEN l_returnflag = 'R' AND coalesce(t.usable, false) THEN 'table' WHEN a.asset IS NOT NULL THEN 'image' END AS slide_kind
  FROM line l LEFT JOIN assets a ON a.deck_id = l.l_orderkey AND a.figure_id = l.figure_id LEFT JOIN tables t ON t.deck_id = l.l_orderkey AND t.figure_id = l.figure_id)"""


def _resolved(spark, folder):
    line = load(spark, folder, "lineitem")
    rank = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    key = [F.col("l_orderkey").alias("deck_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("figure_id")]
    refs = position_in_groups(
        line, ["l_orderkey"], [F.col(c.strip()) for c in _LINE.split(",")], F.floor(F.col("l_partkey") / 64), "ref_ord"
    ).select(*key, "ref_ord", F.when(F.col("l_returnflag") == "R", "table").otherwise("chart").alias("kind"))
    assets = line.where("l_linestatus = 'F'").select(
        *key, F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("asset"), rank.alias("ord")
    )
    tables = line.where("l_discount > 0.05").select(
        *key, F.array_repeat(F.lit("h"), (F.col("l_partkey") % 3).cast("int")).alias("headers"),
        F.array_repeat(F.lit("r"), (F.col("l_suppkey") % 2).cast("int")).alias("rows"), rank.alias("ord"),
    )
    return joins.resolve_figures(refs, assets, tables)


@query("j7_resolved_figures", _FIGURES + " SELECT deck_id, ref_ord, figure_id, slide_kind FROM resolved WHERE slide_kind IS NOT NULL")
def j7(spark, folder):
    return _resolved(spark, folder).select("deck_id", "ref_ord", "figure_id", "slide_kind")


@query(
    "g8_figure_slides",
    _FIGURES
    + """, figs AS (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY ref_ord) - 1 AS n FROM resolved WHERE slide_kind IS NOT NULL),
counts AS (SELECT deck_id, count(*) AS k FROM figs GROUP BY deck_id),
base AS (SELECT o_orderkey AS deck_id, o_custkey % 5 + 2 AS last FROM orders)
SELECT b.deck_id, CAST(CASE WHEN p = last THEN p + coalesce(k, 0) ELSE p END AS INTEGER) AS position, CASE WHEN p = 0 THEN 'title' WHEN p = last THEN 'closingCTA' ELSE 'keyPoints' END AS layout
FROM base b LEFT JOIN counts c ON b.deck_id = c.deck_id, unnest(range(0, last + 1)) AS g(p)
UNION ALL SELECT f.deck_id, CAST(last + n AS INTEGER), CASE WHEN slide_kind = 'table' THEN 'figureTableSlide' ELSE 'figureSlide' END FROM figs f JOIN base b ON f.deck_id = b.deck_id""",
)
def g8(spark, folder):
    last = (F.col("o_custkey") % 5 + 2).cast("int")
    plan = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("deck_id"), last.alias("_end"), F.explode(F.sequence(F.lit(0), last)).alias("position")
    ).select(
        "deck_id", "position",
        F.when(F.col("position") == 0, "title").when(F.col("position") == F.col("_end"), "closingCTA").otherwise("keyPoints").alias("layout"),
    )
    return decks.with_figure_slides(plan, _resolved(spark, folder))


@query(
    "u3_merged_assets",
    """SELECT l_orderkey, 'chart' AS kind, l_partkey, NULL::BIGINT AS l_suppkey FROM lineitem WHERE l_returnflag <> 'R'
       UNION ALL SELECT l_orderkey, 'formula', NULL, l_suppkey FROM lineitem WHERE l_returnflag = 'R'""",
)
def u3(spark, folder):
    line = load(spark, folder, "lineitem")
    charts = line.where("l_returnflag <> 'R'").select("l_orderkey", F.lit("chart").alias("kind"), "l_partkey")
    formulas = line.where("l_returnflag = 'R'").select("l_orderkey", F.lit("formula").alias("kind"), "l_suppkey")
    return decks.merge_assets(charts, formulas)


# --- arcs and picks -------------------------------------------------------------------------

_ATOMS = """, atoms AS (SELECT video_id, ord FROM frames WHERE event_type IN ('click', 'purchase')
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ord) <= 4)"""


def _atoms(spark, folder):
    kind = F.col("event_type")
    typed = frames(spark, folder).withColumn(
        "type", F.when(kind == "click", "fact").when(kind == "purchase", "tip").otherwise("quote")
    )
    return ranking.highlight_atoms(typed)


@query("l6_highlight_atoms", ctes("frames", _ATOMS + " SELECT * FROM atoms"))
def l6(spark, folder):
    return _atoms(spark, folder).select("video_id", "ord")


@query(
    "l7_quota_questions",
    ctes(
        "frames",
        """, pairs AS (SELECT video_id, ord, CASE event_type WHEN 'view' THEN 'advanced' WHEN 'click' THEN 'intermediate' WHEN 'signup' THEN 'foundational' ELSE 'other' END AS level FROM frames),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, level ORDER BY ord) AS n, CASE level WHEN 'advanced' THEN 0 WHEN 'intermediate' THEN 1 ELSE 2 END AS lr FROM pairs WHERE level <> 'other'),
picked AS (SELECT * FROM ranked WHERE n <= CASE level WHEN 'foundational' THEN 2 ELSE 3 END)
SELECT video_id, ord, level, CAST(row_number() OVER (PARTITION BY video_id ORDER BY lr, ord) AS INTEGER) AS rank FROM picked
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY lr, ord) <= 8""",
    ),
)
def l7(spark, folder):
    kind = F.col("event_type")
    pairs = frames(spark, folder).select(
        "video_id", "ord",
        F.when(kind == "view", "advanced").when(kind == "click", "intermediate").when(kind == "signup", "foundational").otherwise("other").alias("level"),
    )
    return ranking.quota_questions(pairs)


@query(
    "l8_best_sections",
    f"""WITH s AS (SELECT c_nationkey AS sector_id, c_custkey AS video_id, o_orderkey AS ord, {RELEVANCE} * CAST(floor(o_totalprice / 5500) AS BIGINT) AS score
         FROM orders JOIN customer ON o_custkey = c_custkey)
       SELECT *, CAST(row_number() OVER (PARTITION BY sector_id ORDER BY score DESC, video_id, ord) AS INTEGER) AS rank FROM s
       QUALIFY row_number() OVER (PARTITION BY sector_id ORDER BY score DESC, video_id, ord) <= 12""",
)
def l8(spark, folder):
    customer = load(spark, folder, "customer").withColumn("video_relevance", relevance())
    joined = load(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("sector_id"), F.col("c_custkey").alias("video_id"), F.col("o_orderkey").alias("ord"),
        "video_relevance", F.floor(F.col("o_totalprice") / 5500).alias("section_relevance"),
    )
    return ranking.best_sections(joined, 12).drop("video_relevance", "section_relevance")


@query(
    "g9_narrative_arc",
    ctes(
        "frames sections",
        _ATOMS
        + """, videos AS (SELECT video_id, video_id * 7 % 100 AS rel FROM recordings),
steps AS (
  SELECT video_id, 0 AS part, 0 AS section, 0 AS minor, 0 AS item, 'cover' AS step FROM videos
  UNION ALL SELECT video_id, 1, 0, 0, 0, 'timeline' FROM videos
  UNION ALL SELECT video_id, 2, index, 0, 0, 'section_intro' FROM sections
  UNION ALL SELECT video_id, 2, index, 1, 0, 'key_points' FROM sections WHERE (index + video_id) % 4 >= 2
  UNION ALL SELECT video_id, 2, section_index, 2, ord, 'figure' FROM frames WHERE event_type = 'error'
  UNION ALL SELECT video_id, 3, 0, 0, ord, 'atom_highlight' FROM atoms
  UNION ALL SELECT video_id, 4, 0, 0, 0, 'summary' FROM videos
  UNION ALL SELECT video_id, 5, 0, 0, 0, 'low_relevance' FROM videos WHERE rel < 30)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY part, section, minor, item) - 1 AS position, step, CAST(section AS BIGINT) AS section FROM steps""",
    ),
)
def g9(spark, folder):
    videos = recordings(spark, folder).select("video_id", (F.col("video_id") * 7 % 100).alias("relevance_pct"))
    parts = sections(spark, folder).withColumn("n_key_points", (F.col("index") + F.col("video_id")) % 4)
    figures = frames(spark, folder).where("event_type = 'error'").withColumn("index", F.col("section_index"))
    return decks.narrative_arc(videos, parts, figures, _atoms(spark, folder))


@query(
    "g10_concept_pages",
    ctes(
        "frames",
        """, c AS (SELECT video_id, ord, row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM frames WHERE event_type = 'click')
SELECT video_id, ord, CASE WHEN n > 12 THEN pos // 4 ELSE 0 END AS page FROM c""",
    ),
)
def g10(spark, folder):
    concepts = frames(spark, folder).where("event_type = 'click'").select("video_id", "ord")
    return decks.concept_pages(concepts)


# --- keys -----------------------------------------------------------------------------------


@query("j11_new_manifests", "SELECT o_orderkey AS manifest_id, o_custkey FROM orders WHERE o_orderkey % 3 <> 0")
def j11(spark, folder):
    o = load(spark, folder, "orders").select(F.col("o_orderkey").alias("manifest_id"), "o_custkey")
    return joins.new_manifests(o, o.where("manifest_id % 3 = 0"))


@query(
    "j12_card_videos",
    """WITH hop AS (SELECT o.o_orderkey AS card_id, CASE WHEN o.o_orderkey % 5 <> 0 THEN o.o_custkey END AS user_id,
         s.o_custkey AS video_ref, s.o_custkey + s.o_orderkey % 2 AS owner_id, c.c_name AS external_id
       FROM orders o LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) s ON o.o_orderkey = s.o_orderkey
       LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) c ON c.c_custkey = s.o_custkey),
judged AS (SELECT *, CASE WHEN owner_id IS NULL THEN 'card_missing' WHEN user_id <> owner_id THEN 'not_owner' WHEN external_id IS NULL THEN 'video_missing' END AS reject_reason FROM hop)
SELECT card_id, CASE WHEN reject_reason IS NULL THEN external_id END AS external_id, reject_reason FROM judged""",
)
def j12(spark, folder):
    o = load(spark, folder, "orders")
    cards = o.select(F.col("o_orderkey").alias("card_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("user_id"))
    states = o.where("o_orderkey % 7 <> 0").select(
        F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("video_ref"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("user_id")
    )
    videos = load(spark, folder, "customer").where("c_custkey % 9 <> 0").select(
        F.col("c_custkey").alias("video_ref"), F.col("c_name").alias("external_id")
    )
    return joins.card_videos(cards, states, videos).select("card_id", "external_id", "reject_reason")


@query(
    "j13_collection_rollup",
    """SELECT r_name, n_name, c_custkey AS video_id, o_orderkey AS section_id FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def j13(spark, folder):
    return joins.collection_rollup(
        load(spark, folder, "region").select(F.col("r_regionkey").alias("collection_id"), "r_name"),
        load(spark, folder, "nation").select(F.col("n_nationkey").alias("sector_id"), F.col("n_regionkey").alias("collection_id"), "n_name"),
        load(spark, folder, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("sector_id")),
        load(spark, folder, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("section_id")),
    ).select("r_name", "n_name", "video_id", "section_id")


# Every vector is a point of four videos or of one, each time drawn further out of shape.
_COPIES = "list_transform(embedding, lambda x, i: x::DOUBLE * (1 + j * ((vec_id * 31 + (i - 1) * 17) % 9 - 4) * 0.08))"


@query(
    "a20_common_and_distinctive",
    f"""WITH RECURSIVE points AS MATERIALIZED (SELECT label AS sector_id, (vec_id + CASE WHEN vec_id % 3 = 0 THEN j ELSE 0 END) % 7 AS video_id, vec_id * 4 + j AS ord,
  (vec_id * 13 + j * 29) % 100 AS relevance_pct, {_COPIES} AS v FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS j)),
links AS MATERIALIZED (SELECT a.ord AS a, b.ord AS b FROM points a JOIN points b ON a.sector_id = b.sector_id AND a.ord <> b.ord WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT ord AS id, ord AS other FROM points UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
clustered AS (SELECT p.*, c.cluster FROM points p JOIN (SELECT id, min(other) AS cluster FROM reach GROUP BY id) c ON c.id = p.ord),
clusters AS (SELECT sector_id, cluster, count(DISTINCT video_id) AS n_videos, count(*) AS n_points, max(relevance_pct) AS relevance_pct FROM clustered GROUP BY ALL),
best AS (SELECT * FROM clustered QUALIFY row_number() OVER (PARTITION BY sector_id, cluster ORDER BY relevance_pct DESC, video_id, ord) = 1),
kinds AS (SELECT c.*, CASE WHEN n_videos > 1 THEN 'common' ELSE 'distinctive' END AS kind, b.video_id, b.ord FROM clusters c JOIN best b USING (sector_id, cluster))
SELECT sector_id, kind, CAST(row_number() OVER (PARTITION BY sector_id, kind ORDER BY relevance_pct DESC, cluster) AS INTEGER) AS rank, cluster, n_videos, n_points, relevance_pct, video_id, ord
FROM kinds QUALIFY row_number() OVER (PARTITION BY sector_id, kind ORDER BY relevance_pct DESC, cluster) <= 10""",
)
def a20(spark, folder):
    id_, j = F.col("vec_id"), F.col("j")
    copies = load(spark, folder, "embeddings").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    drawn = F.transform("embedding", lambda x, i: x.cast("double") * (1 + j * ((id_ * 31 + i * 17) % 9 - 4) * 0.08))
    points = copies.select(
        F.col("label").alias("sector_id"), ((id_ + F.when(id_ % 3 == 0, j).otherwise(0)) % 7).alias("video_id"), (id_ * 4 + j).alias("ord"),
        ((id_ * 13 + j * 29) % 100).alias("relevance_pct"), drawn.alias("embedding"),
    )
    return topics.common_and_distinctive(points, 10)


# --- slide audits: lines as text shapes -----------------------------------------------------

_SHAPES = """WITH shapes AS (
  SELECT l_suppkey * 10 + l_orderkey % 10 AS deck_id, CAST(l_partkey % 15 AS INTEGER) AS slide_no, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS shape_no,
    l_orderkey % 14 * 914400 AS x, l_partkey % 8 * 914400 - CASE WHEN l_orderkey % 31 = 0 THEN 40000 ELSE 0 END AS y,
    CAST(l_linenumber AS BIGINT) * 457200 AS cx, 914400 AS cy,
    CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_orderkey % 50 = 0 THEN 'starts at 12:30' WHEN l_orderkey % 51 = 0 THEN '이' WHEN l_orderkey % 52 = 0 THEN '영상 “quoted”'
         ELSE trim(repeat('slide text ', l_linenumber)) END AS text,
    l_partkey % 15 % 4 = 0 AS dark, l_orderkey % 25 = 0 AS has_img, l_orderkey % 40 = 0 AS has_tbl FROM lineitem),
facts AS (SELECT deck_id, slide_no, count(*) FILTER (text <> '' AND (x + cx > 13.333 * 914400 + 30000 OR y + cy > 7.5 * 914400 + 30000 OR x < -30000 OR y < -30000)) AS n_overflow,
    bool_or(dark) AS dark, bool_or(has_img) AS has_img, bool_or(has_tbl) AS has_tbl, count(*) FILTER (y / 914400 > 1.45) AS body_shapes,
    min(y / 914400) FILTER (text <> '') AS min_top, max((y + cy) / 914400) FILTER (text <> '') AS max_bottom,
    coalesce(string_agg(text, ' ' ORDER BY shape_no, text) FILTER (text <> ''), '') AS body FROM shapes GROUP BY deck_id, slide_no),
measured AS (SELECT *, CAST(length(trim(body)) AS INTEGER) AS chars, min(slide_no) OVER (PARTITION BY deck_id) AS first, max(slide_no) OVER (PARTITION BY deck_id) AS last,
    count(*) OVER (PARTITION BY deck_id) AS n_slides,
    regexp_extract(body, '(?i)이\\s*영상|영상\\s*에서(?:는)?|본\\s*강의|강사(?:님)?|채널\\s*구독|구독.{0,15}좋아요|출처\\s*영상|동반\\s*별첨|별첨|VIDEO\\s*DIGEST|채널명') AS phrase,
    regexp_extract(body, '\\b\\d{1,2}:\\d{2}\\b') AS clock FROM facts),
audited AS (SELECT *, CASE WHEN phrase <> '' THEN phrase WHEN clock <> '' THEN clock END AS meta_hit,
    CASE WHEN slide_no = first OR slide_no = last OR contains(body, '“') THEN NULL
         WHEN chars < CASE WHEN dark THEN 110 ELSE 160 END AND NOT (has_img OR has_tbl OR body_shapes >= 8) THEN 'sparse'
         WHEN NOT dark AND NOT (has_img OR has_tbl) AND max_bottom < 5.0 AND min_top < 2.0 THEN 'empty_lower_half' END AS density FROM measured)
"""


def shapes(spark, folder):
    line = load(spark, folder, "lineitem")
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    words = (
        F.when(p % 9 == 0, "")
        .when(o % 50 == 0, "starts at 12:30")
        .when(o % 51 == 0, "이")
        .when(o % 52 == 0, "영상 “quoted”")
        .otherwise(F.trim(F.repeat(F.lit("slide text "), n)))
    )
    return line.select(
        (F.col("l_suppkey") * 10 + o % 10).alias("deck_id"), (p % 15).cast("int").alias("slide_no"),
        (o * 100000000 + p * 10 + n).alias("shape_no"), (o % 14 * 914400).alias("x"),
        (p % 8 * 914400 - F.when(o % 31 == 0, 40000).otherwise(0)).alias("y"), (n.cast("bigint") * 457200).alias("cx"),
        F.lit(914400).cast("bigint").alias("cy"), words.alias("text"), (p % 15 % 4 == 0).alias("dark"),
        (o % 25 == 0).alias("has_img"), (o % 40 == 0).alias("has_tbl"),
    )


@query("v1_overflow", _SHAPES + "SELECT deck_id, slide_no, n_overflow FROM facts WHERE n_overflow > 0")
def v1(spark, folder):
    wide = shapes(spark, folder).where(audits.overflows())
    return wide.groupBy("deck_id", "slide_no").agg(F.count(F.lit(1)).alias("n_overflow"))


@query("v2_sparse_slides", _SHAPES + "SELECT deck_id, slide_no, chars FROM audited WHERE density = 'sparse'")
def v2(spark, folder):
    return audits.audit_slides(audits.slide_facts(shapes(spark, folder))).where("density = 'sparse'").select(
        "deck_id", "slide_no", "chars"
    )


@query(
    "v3_empty_lower_half",
    _SHAPES + "SELECT deck_id, slide_no, round(max_bottom, 6) AS max_bottom FROM audited WHERE density = 'empty_lower_half'",
)
def v3(spark, folder):
    hollow = audits.audit_slides(audits.slide_facts(shapes(spark, folder))).where("density = 'empty_lower_half'")
    return hollow.select("deck_id", "slide_no", F.round("max_bottom", 6).alias("max_bottom"))


# Files of a deck: pictures, other media, charts and their styles.
_FILES = """, files AS (SELECT l_suppkey * 10 + l_orderkey % 10 AS deck_id, CASE WHEN l_orderkey % 6 = 0 THEN 'ppt/charts/chart' || l_partkey || '.xml'
    WHEN l_orderkey % 6 = 1 THEN 'ppt/charts/style' || l_partkey || '.xml' ELSE 'ppt/media/image' || l_partkey || ['.png', '.JPG', '.svg', '.emf'][1 + l_orderkey % 4] END AS name FROM lineitem),
counted AS (SELECT deck_id, count(DISTINCT name) FILTER (starts_with(name, 'ppt/media/') AND regexp_matches(name, '(?i)[.](png|jpg|jpeg|gif|emf)$')) AS images,
    count(DISTINCT name) FILTER (starts_with(name, 'ppt/media/')) AS media, count(DISTINCT name) FILTER (regexp_matches(name, '^ppt/charts/chart[0-9]+[.]xml$')) AS charts FROM files GROUP BY deck_id)"""
_VERDICT = _FILES + """, pages_of AS (SELECT deck_id, count(*) AS n_slides, count(*) FILTER (n_overflow > 0) AS overflow_slides, count(meta_hit) AS meta_slides,
  count(density) AS thin_slides, coalesce(any_value(images), 0) AS images FROM audited LEFT JOIN counted USING (deck_id) GROUP BY deck_id)"""


def _files(spark, folder):
    o, p = F.col("l_orderkey"), F.col("l_partkey").cast("string")
    ending = F.array(*[F.lit(e) for e in (".png", ".JPG", ".svg", ".emf")])[(o % 4).cast("int")]
    name = (
        F.when(o % 6 == 0, F.concat(F.lit("ppt/charts/chart"), p, F.lit(".xml")))
        .when(o % 6 == 1, F.concat(F.lit("ppt/charts/style"), p, F.lit(".xml")))
        .otherwise(F.concat(F.lit("ppt/media/image"), p, ending))
    )
    return load(spark, folder, "lineitem").select((F.col("l_suppkey") * 10 + o % 10).alias("deck_id"), name.alias("name"))


def _audited(spark, folder):
    return audits.audit_slides(audits.slide_facts(shapes(spark, folder)))


@query(
    "v4_deck_verdicts",
    _SHAPES + _VERDICT + """ SELECT *, overflow_slides + meta_slides + thin_slides + (n_slides < 12)::INT AS hard_problems,
       overflow_slides + meta_slides + thin_slides + (n_slides < 12)::INT = 0 AS passes FROM pages_of""",
)
def v4(spark, folder):
    return audits.deck_verdicts(_audited(spark, folder), files=_files(spark, folder))


@query(
    "v4_lenient_verdicts",
    _SHAPES + _VERDICT + """ SELECT deck_id, overflow_slides + meta_slides + (n_slides < 5)::INT AS hard_problems,
       overflow_slides + meta_slides + (n_slides < 5)::INT = 0 AS passes FROM pages_of""",
)
def v4_lenient(spark, folder):
    audited = audits.audit_slides(audits.slide_facts(shapes(spark, folder)))
    return audits.deck_verdicts(audited, 5, lenient=True).select("deck_id", "hard_problems", "passes")


@query(
    "v5_required_images",
    _SHAPES + _VERDICT + " SELECT deck_id, images, images < 20 AS too_few FROM pages_of",
)
def v5(spark, folder):
    verdicts = audits.deck_verdicts(_audited(spark, folder), 0, True, 20, _files(spark, folder))
    # Of the problems counted here only the gate is neither overflow nor phrases.
    others = F.col("overflow_slides") + F.col("meta_slides")
    return verdicts.select("deck_id", "images", (F.col("hard_problems") > others).alias("too_few"))


@query(
    "a15_slide_text_stats",
    _SHAPES + _FILES + """SELECT deck_id, max(n_slides) AS n_slides, min(chars) FILTER (slide_no <> first OR n_slides = 1) AS min_chars,
       max(chars) FILTER (slide_no <> first OR n_slides = 1) AS max_chars, count(*) FILTER (has_tbl) AS table_slides,
       coalesce(any_value(media), 0) AS n_media, coalesce(any_value(charts), 0) AS n_charts
       FROM measured LEFT JOIN counted USING (deck_id) GROUP BY deck_id""",
)
def a15(spark, folder):
    return audits.text_stats(audits.slide_facts(shapes(spark, folder)), _files(spark, folder))


# --- manifests: orders with their lines as figures ------------------------------------------

_MANIFEST = """WITH figures AS (
  SELECT l_orderkey AS manifest_id, 'f' || l_linenumber AS figure_id, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 <> 0 THEN 'redrawn' ELSE 'keyframe' END AS kind,
    CASE WHEN l_partkey % 50 = 0 THEN 'unknown' WHEN l_partkey % 51 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'verified' WHEN l_returnflag = 'N' THEN 'unverified' ELSE 'dropped' END AS verification_status,
    CASE WHEN (l_returnflag <> 'R') = (l_suppkey % 20 <> 0) THEN 'p' END AS png,
    CASE WHEN (l_returnflag = 'A' AND l_linenumber % 3 <> 0) = (l_suppkey % 21 <> 0) THEN 'v' END AS vec,
    CASE WHEN (l_returnflag = 'R') = (l_suppkey % 22 <> 0) THEN 'low' END AS drop_reason, l_partkey % 4 AS n_atom_refs, l_suppkey % 5 <> 0 AS has_data FROM lineitem)
"""
_BROKEN = """, copies AS (SELECT manifest_id, figure_id, count(*) AS n FROM figures GROUP BY ALL),
marked AS (SELECT f.*, n, coalesce(verification_status = 'dropped', false) AS dropped, kind = 'redrawn' AS redrawn,
  coalesce(verification_status = 'verified', false) AND kind = 'redrawn' AS drawn FROM figures f JOIN copies c ON f.manifest_id = c.manifest_id AND f.figure_id = c.figure_id),
audited AS (SELECT manifest_id, figure_id, l_partkey, l_suppkey, verification_status, concat_ws(',', CASE WHEN n > 1 THEN 'unique_id' END,
  CASE WHEN verification_status IS NULL OR verification_status = 'unknown' THEN 'known_status' END,
  CASE WHEN (png IS NOT NULL) <> (NOT dropped) THEN 'png_iff_kept' END, CASE WHEN (vec IS NOT NULL) <> drawn THEN 'vectors_iff_verified_redrawn' END,
  CASE WHEN (drop_reason IS NOT NULL) <> dropped THEN 'reason_iff_dropped' END, CASE WHEN redrawn AND n_atom_refs = 0 THEN 'redrawn_has_atoms' END,
  CASE WHEN drawn AND NOT has_data THEN 'verified_redrawn_has_data' END, CASE WHEN dropped AND (png IS NOT NULL OR vec IS NOT NULL) THEN 'dropped_has_no_asset' END) AS broken_rules FROM marked)
"""


def manifest_figures(spark, folder):
    line = load(spark, folder, "lineitem")
    p, s, flag = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")
    redrawn = F.col("l_linenumber") % 3 != 0
    vector = F.when(((flag == "A") & redrawn) == (s % 21 != 0), "v")
    return line.select(
        F.col("l_orderkey").alias("manifest_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("figure_id"), p, s,
        F.when(redrawn, "redrawn").otherwise("keyframe").alias("kind"),
        F.when(p % 50 == 0, "unknown").when(p % 51 == 0, F.lit(None)).when(flag == "A", "verified").when(flag == "N", "unverified").otherwise("dropped").alias("verification_status"),
        F.when((flag != "R") == (s % 20 != 0), "p").alias("png"), vector.alias("pdf"), vector.alias("svg"),
        F.when((flag == "R") == (s % 22 != 0), "low").alias("drop_reason"), (p % 4).alias("n_atom_refs"), (s % 5 != 0).alias("has_data"),
    )


@query(
    "v7_manifest_figures",
    _MANIFEST + _BROKEN + """SELECT manifest_id, figure_id, l_partkey, l_suppkey, broken_rules,
       CASE WHEN broken_rules <> '' THEN 'dropped' ELSE verification_status END AS final_status FROM audited""",
)
def v7(spark, folder):
    return audits.audit_figures(manifest_figures(spark, folder)).select(
        "manifest_id", "figure_id", "l_partkey", "l_suppkey", "broken_rules", "final_status"
    )


_SUMMARY = """, summary AS (SELECT manifest_id, count(*) AS total, count(*) FILTER (verification_status = 'verified') AS verified,
  count(*) FILTER (verification_status = 'unverified') AS unverified, count(*) FILTER (verification_status = 'dropped') AS dropped,
  count(*) FILTER (kind = 'redrawn') AS redrawn, count(*) FILTER (kind = 'keyframe') AS keyframes FROM figures GROUP BY manifest_id)
"""


@query("a16_manifest_summary", _MANIFEST + _SUMMARY + "SELECT * FROM summary")
def a16(spark, folder):
    return audits.manifest_summary(manifest_figures(spark, folder))


@query(
    "v7_manifest_summaries",
    _MANIFEST + _SUMMARY + """, stated AS (SELECT manifest_id, total + (manifest_id % 8 = 0)::INT AS total, verified, unverified, dropped, redrawn, keyframes FROM summary)
SELECT t.manifest_id, t.total = s.total AS total_ok, t.verified + t.unverified + t.dropped = t.total AS status_ok, t.redrawn + t.keyframes = t.total AS kind_ok
FROM stated t JOIN summary s ON t.manifest_id = s.manifest_id""",
)
def v7_summaries(spark, folder):
    figures = manifest_figures(spark, folder)
    stated = audits.manifest_summary(figures).withColumn(
        "total", F.col("total") + (F.col("manifest_id") % 8 == 0).cast("int")
    )
    return audits.audit_summaries(stated, figures)


@query(
    "a17_review_flags",
    _MANIFEST + _SUMMARY + """SELECT manifest_id, round(unverified / total, 6) AS unverified_share, unverified / total > 0.15 AS needs_review,
       verified / total >= 0.6 AND unverified / total <= 0.15 AND dropped / total <= 0.25 AS mix_on_target FROM summary""",
)
def a17(spark, folder):
    flags = audits.review_flags(audits.manifest_summary(manifest_figures(spark, folder)))
    return flags.select("manifest_id", F.round("unverified_share", 6).alias("unverified_share"), "needs_review", "mix_on_target")


@query(
    "v8_low_resolution",
    """SELECT p_partkey, CASE WHEN 200 + p_size * 5 < 300 AND p_type <> 'ECONOMY' THEN 'unverified' WHEN p_type = 'ECONOMY' THEN 'dropped' ELSE 'verified' END AS status FROM part""",
)
def v8(spark, folder):
    status = F.when(F.col("p_type") == "ECONOMY", "dropped").otherwise("verified")
    return load(spark, folder, "part").select(
        "p_partkey", audits.low_resolution(status, 200 + F.col("p_size") * 5).alias("status")
    )


@query(
    "a18_point_errors",
    """WITH p AS (SELECT o_custkey AS chart, o_totalprice AS v, o_totalprice * (1 + (o_orderkey % 5 - 2) / 97) AS f FROM orders)
       SELECT chart, round(avg(abs(f - v)), 4) AS mae, round(avg(abs(f - v) / abs(v)), 6) AS mape FROM p GROUP BY chart""",
)
def a18_points(spark, folder):
    truth = load(spark, folder, "orders").select(
        F.col("o_custkey").alias("chart"), F.col("o_orderkey").alias("point"), F.col("o_totalprice").alias("value")
    )
    found = truth.withColumn("value", F.col("value") * (1 + (F.col("point") % 5 - 2) / 97))
    errors = audits.point_errors(truth, found, "chart")
    return errors.select("chart", F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape"))


@query(
    "a18_cell_scores",
    """WITH c AS (SELECT c_nationkey AS tbl, c_custkey % 6 <> 0 AS found, c_custkey % 6 <> 0 AND c_custkey % 7 <> 0 AS hit FROM customer),
n AS (SELECT tbl, count(*) AS t, count(*) FILTER (found) AS f, count(*) FILTER (hit) AS hits FROM c GROUP BY tbl)
SELECT tbl, hits, round(hits / f, 6) AS "precision", round(hits / t, 6) AS recall, round(2 * hits / (t + f), 6) AS f1 FROM n""",
)
def a18_cells(spark, folder):
    truth = load(spark, folder, "customer").select(
        F.col("c_nationkey").alias("tbl"), F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("text")
    )
    found = truth.where("cell % 6 <> 0").withColumn(
        "text", F.when(F.col("cell") % 7 == 0, "?").otherwise(F.col("text"))
    )
    scores = audits.cell_scores(truth, found, "tbl")
    return scores.select("tbl", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "a18_latex_distance",
    """SELECT p_brand, round(avg(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))), 6) AS edit_distance FROM part GROUP BY p_brand""",
)
def a18_latex(spark, folder):
    part = load(spark, folder, "part")
    truth = part.select("p_brand", F.col("p_partkey").alias("formula"), F.col("p_name").alias("latex"))
    found = part.select("p_brand", F.col("p_partkey").alias("formula"), F.col("p_type").alias("latex"))
    return audits.latex_distance(truth, found, "p_brand").select("p_brand", F.round("edit_distance", 6).alias("edit_distance"))
