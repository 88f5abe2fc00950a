"""Queries for gates over summaries, boxes, crops and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import structs, timeline
from cuesheet.functions.text import edit_share
from cuesheet.operators import gates, ranking
from cuesheet.plans.bindings import boxes, ctes, frames, slides
from cuesheet.plans.registry import load, query
from cuesheet.sources import readers

# --- summaries: documents with their labels -------------------------------------------------


def _summaries(spark, folder):
    labels = load(spark, folder, "labels")
    docs = load(spark, folder, "documents").select("doc_id", "lang")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("video_id"),
        F.when(F.col("doc_id") % 17 == 0, "v1").otherwise("v2").alias("template_version"),
        F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("quality_flag"),
        (F.col("toxic") == 0).alias("transcript_used"),
        "lang",
    )


_SUMMARIES = """WITH summaries AS (
  SELECT l.doc_id AS video_id, CASE WHEN l.doc_id % 17 = 0 THEN 'v1' ELSE 'v2' END AS template_version,
         CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS quality_flag, toxic = 0 AS transcript_used, lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
gated AS (
  SELECT d.doc_id AS video_id, s.lang,
         CASE WHEN s.video_id IS NULL THEN 'missing' WHEN template_version <> 'v2' THEN 'template_version'
              WHEN quality_flag <> 'pass' THEN 'quality_flag' WHEN NOT transcript_used THEN 'transcript_used' END AS gate_reason
  FROM documents d LEFT JOIN summaries s ON d.doc_id = s.video_id)
"""


def gated_summaries(spark, folder):
    wanted = load(spark, folder, "documents").select(F.col("doc_id").alias("video_id"))
    return gates.gate_summaries(wanted, _summaries(spark, folder))


@query("p1_summary_gate", _SUMMARIES + "SELECT video_id, gate_reason FROM gated")
def p1(spark, folder):
    return gated_summaries(spark, folder).select("video_id", "gate_reason")


@query("s2_passing_summaries", _SUMMARIES + "SELECT video_id, lang FROM gated WHERE gate_reason IS NULL")
def s2(spark, folder):
    return gated_summaries(spark, folder).where("gate_reason is null").select("video_id", "lang")


# Documents as nested summaries. Every 7th to 13th is broken in a way of its own.
_NESTED = """WITH judged AS (SELECT doc_id, printf('%011d', doc_id) AS video_id, lang, text, CAST(doc_id % 4 AS INTEGER) AS n,
  CASE WHEN doc_id % 7 = 0 THEN '$.core.domain' WHEN doc_id % 11 = 0 THEN '$.segments'
       WHEN doc_id % 13 = 0 AND doc_id % 4 >= 2 THEN '$.segments.sections[1].relevance_pct' WHEN doc_id % 17 = 0 THEN '$' END AS bad_path FROM documents)
"""


def _nested(spark, folder):
    d, n = F.col("doc_id"), F.col("doc_id") % 4
    core = F.struct(
        F.lit("one").alias("one_liner"), F.when(d % 7 != 0, F.lit("d")).alias("domain"), F.lit("deep").alias("depth_level"),
        F.lit("talk").alias("content_type"), F.lit("all").alias("target_audience"),
    )
    wrong = d % 13 == 0

    def section(i):
        pct = F.to_variant_object(F.array(i * 10))
        share = F.when(wrong & (i == 1), F.parse_json(F.lit('"high"'))).otherwise(F.try_variant_get(pct, "$[0]", "variant"))
        return F.struct(
            (i * 60.5).alias("from_sec"), (i * 60.5 + 30).alias("to_sec"), F.concat(F.lit("part "), i.cast("string")).alias("title"),
            F.lit(None).cast("string").alias("summary"), share.alias("relevance_pct"),
        )

    sections = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < n), section)
    segments = F.when(d % 11 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct(sections.alias("sections"))))
    # A field that is null is left out of the text.
    head = F.to_json(
        F.struct(
            F.format_string("%011d", d).alias("video_id"), F.lit("v2").alias("template_version"), F.col("lang").alias("source_language"),
            F.lit("pass").alias("quality_flag"), F.lit(True).alias("transcript_used"), core.alias("core"), F.struct(F.lit("x").alias("other")).alias("analysis"),
        )
    )
    whole = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(', "segments": '), segments, F.when(d % 17 == 0, F.lit(",")).otherwise(F.lit("}")))
    return load(spark, folder, "documents").select(whole.alias("raw"), F.format_string("%011d", d).alias("id"))


@query(
    "s2_summary_sections",
    _NESTED
    + """SELECT video_id, CAST(i AS INTEGER) AS index, i * 60.5::DOUBLE AS from_sec, i * 60.5::DOUBLE + 30 AS to_sec, 'part ' || i AS title, i * 10::DOUBLE AS relevance_pct
FROM judged, unnest(range(0, n)) AS g(i) WHERE bad_path IS NULL""",
)
def s2_sections(spark, folder):
    good, _ = readers.parse_summaries(_nested(spark, folder))
    return readers.summary_sections(good).drop("summary")


@query(
    "s2_summary_quarantine",
    _NESTED + "SELECT video_id, CASE WHEN doc_id % 17 = 0 THEN '$' ELSE bad_path END AS bad_path FROM judged WHERE bad_path IS NOT NULL",
)
def s2_quarantine(spark, folder):
    _, bad = readers.parse_summaries(_nested(spark, folder))
    return bad.select(F.col("id").alias("video_id"), "bad_path")


@query(
    "p15_input_unsuitable",
    _SUMMARIES
    + """, runs AS (SELECT g.video_id, g.gate_reason, CASE WHEN d.doc_id % 2 = 0 THEN 'acquire' ELSE 'detect' END AS stage,
  CASE d.doc_id % 5 WHEN 0 THEN 'ERROR: Video Unavailable' WHEN 1 THEN 'this is age restricted' WHEN 2 THEN 'account x terminated'
       WHEN 3 THEN 'timeout' END AS error
  FROM gated g JOIN documents d ON d.doc_id = g.video_id)
SELECT video_id, gate_reason IS NOT NULL OR coalesce(stage = 'acquire' AND regexp_matches(error,
  '(?i)video unavailable|private video|members-only|has been removed|not available|age[- ]restricted|account .* terminated'), false) AS input_unsuitable
FROM runs""",
)
def p15(spark, folder):
    v = F.col("video_id")
    error = (
        F.when(v % 5 == 0, "ERROR: Video Unavailable")
        .when(v % 5 == 1, "this is age restricted")
        .when(v % 5 == 2, "account x terminated")
        .when(v % 5 == 3, "timeout")
    )
    stage = F.when(v % 2 == 0, "acquire").otherwise("detect")
    return gated_summaries(spark, folder).select(
        "video_id", gates.input_unsuitable(stage, error, F.col("gate_reason")).alias("input_unsuitable")
    )


@query(
    "p24_needs_figure",
    r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN false WHEN 1 THEN true
         ELSE regexp_matches(text, '(?i)\b(?:graph|chart|table|equation|formula|diagram)s?\b|\\(?:frac|sum|int)\b') END AS needs_figure
       FROM documents""",
)
def p24(spark, folder):
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, "vlog").when(d % 3 == 1, "lecture").otherwise("other")
    return load(spark, folder, "documents").select(
        "doc_id", gates.needs_figure(kind, F.col("text")).alias("needs_figure")
    )


# --- relevance: customers as videos of a nation ---------------------------------------------

RELEVANCE = "least(100, greatest(0, CAST(floor((c_acctbal + 1000) / 110) AS BIGINT)))"


def relevance():
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor((F.col("c_acctbal") + 1000) / 110))).cast("bigint")


def _customers(spark, folder):
    return load(spark, folder, "customer").withColumns(
        {"relevance_pct": relevance(), "visual": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    )


_VISUAL = "c_mktsegment IN ('BUILDING', 'MACHINERY')"


@query(
    "p3_relevance_path",
    f"""SELECT c_custkey, {RELEVANCE} AS relevance_pct,
          CASE WHEN {RELEVANCE} >= 60 AND {_VISUAL} THEN 'path1_figure' ELSE 'path2_text' END AS path FROM customer""",
)
def p3(spark, folder):
    return _customers(spark, folder).select(
        "c_custkey", "relevance_pct", gates.relevance_path(F.col("relevance_pct"), F.col("visual")).alias("path")
    )


@query(
    "p25_section_display",
    f"SELECT c_custkey, CASE WHEN {RELEVANCE} < 20 AND NOT {_VISUAL} THEN 'agenda_only' ELSE 'full' END AS display FROM customer",
)
def p25(spark, folder):
    return _customers(spark, folder).select(
        "c_custkey", gates.section_display(F.col("relevance_pct"), F.col("visual")).alias("display")
    )


@query("p26_low_alignment", f"SELECT c_custkey, {RELEVANCE} < 30 AS low_alignment FROM customer")
def p26(spark, folder):
    return _customers(spark, folder).select(
        "c_custkey", gates.low_alignment(F.col("relevance_pct")).alias("low_alignment")
    )


# --- frames and their boxes: orders and their lines -----------------------------------------

_KIND = """CASE cls WHEN 'figure' THEN 'diagram' WHEN 'table' THEN 'table' WHEN 'isolate_formula' THEN 'equation'
  WHEN 'plain text' THEN 'text' WHEN 'abandon' THEN 'drop' ELSE 'other' END"""
_CONTENT = f""", kinds AS (SELECT *, {_KIND} AS kind, w * h AS area FROM boxes),
content AS (
  SELECT frame_id, count(*) AS content_boxes, count(*) FILTER (kind IN ('diagram', 'table', 'equation')) AS fig_box_count,
         bool_or(kind IN ('equation', 'table', 'text') AND area >= 0.02 * 5000)
         OR bool_or(kind = 'diagram' AND score >= 0.8)
         OR (bool_or(kind = 'diagram' AND area >= 0.2 * 5000 AND area <= 0.85 * 5000) AND count(*) >= 2) AS has_content
  FROM kinds WHERE kind <> 'drop' GROUP BY frame_id)"""


@query(
    "f8_box_kinds",
    ctes("boxes", f"SELECT frame_id, box_index, cls, {_KIND} AS kind FROM boxes"),
)
def f8(spark, folder):
    return boxes(spark, folder).select(
        "frame_id", "box_index", "cls", timeline.box_kind(F.col("cls")).alias("kind")
    )


@query("p4_frame_content", ctes("boxes", _CONTENT + " SELECT frame_id, content_boxes, has_content FROM content"))
def p4(spark, folder):
    return gates.frame_content(boxes(spark, folder, numbered=False)).select(
        "frame_id", "content_boxes", "has_content"
    )


@query("a2_figure_boxes", ctes("boxes", _CONTENT + " SELECT frame_id, fig_box_count FROM content"))
def a2(spark, folder):
    return gates.frame_content(boxes(spark, folder, numbered=False)).select("frame_id", "fig_box_count")


@query(
    "p5_gate_frames",
    ctes(
        "boxes",
        _CONTENT
        + """, judged AS (
  SELECT o_custkey AS video_id, o_orderkey AS frame_id, coalesce(fig_box_count, 0) AS fig_box_count,
         o_orderpriority = '5-LOW' OR coalesce(has_content, false) AS keep0
  FROM orders LEFT JOIN content ON frame_id = o_orderkey)
SELECT video_id, frame_id, fig_box_count, NOT bool_or(keep0) OVER (PARTITION BY video_id) AS starved,
       keep0 OR NOT bool_or(keep0) OVER (PARTITION BY video_id) AS keep FROM judged""",
    ),
)
def p5(spark, folder):
    shots = load(spark, folder, "orders").select(
        F.col("o_custkey").alias("video_id"),
        F.col("o_orderkey").alias("frame_id"),
        (F.col("o_orderpriority") == "5-LOW").alias("detect_error"),
        F.lit(5000.0).alias("frame_area"),
    )
    content = gates.frame_content(boxes(spark, folder, numbered=False))
    return gates.gate_frames(shots, content).select(
        "video_id", "frame_id", "fig_box_count", "starved", "keep"
    )


@query(
    "l2_strongest_boxes",
    ctes(
        "boxes",
        """SELECT frame_id, box_index, round(score, 6) AS score FROM boxes WHERE score >= 0.15
           QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, box_index) <= 3""",
    ),
)
def l2(spark, folder):
    # An order has few lines, so the cap is 3 here instead of 50.
    return ranking.strongest_boxes(boxes(spark, folder), 3).select(
        "frame_id", "box_index", F.round("score", 6).alias("score")
    )


_PIN = "CAST(greatest(0, least(round_even({0}, 0), {1})) AS INTEGER)"
_X0, _Y0 = _PIN.format("x", "img_w"), _PIN.format("y", "img_h")
_X1, _Y1 = _PIN.format("x + w", "img_w"), _PIN.format("y + h", "img_h")


@query(
    "f7_clamped_boxes",
    ctes(
        "boxes",
        f"""SELECT frame_id, box_index, {_X0} AS x, {_Y0} AS y, {_X1} - {_X0} AS w, {_Y1} - {_Y0} AS h
            FROM boxes WHERE {_X1} > {_X0} AND {_Y1} > {_Y0}""",
    ),
)
def f7(spark, folder):
    box = timeline.clamped_box(*[F.col(c) for c in ("x", "y", "w", "h", "img_w", "img_h")])
    return boxes(spark, folder).select("frame_id", "box_index", box.alias("box")).where("box is not null").select(
        "frame_id", "box_index", "box.*"
    )


# --- crops: a struct is built from the numbers of a box -------------------------------------

_KINDS = ("chart", "diagram", "table", "equation", "photo")
_INSIGHTS = ("values stay constant", "a rising series", "uniform load", "no claim")


def crops(spark, folder):
    """Classified crops: kind, second reading, confidence and a JSON struct per box."""
    b = boxes(spark, folder)
    s = (F.col("score") * 10).cast("int")
    kind = F.array(*[F.lit(k) for k in _KINDS])
    pick = (F.col("x").cast("int") + 10) % 5
    insight = F.array(*[F.lit(i) for i in _INSIGHTS])[(F.col("w").cast("int")) % 4]
    chart = F.format_string(
        '{"chart_type":"%s","insight":"%s","series":[{"name":"a","points":[{"x":1,"y":%d},{"x":2,"y":%d},{"x":3,"value":%d}]}]}',
        F.when(F.col("w") % 2 == 0, "line").otherwise("bar"),
        insight,
        F.col("w").cast("int"),
        F.col("w").cast("int") + F.col("h").cast("int") % 20,
        F.col("w").cast("int"),
    )
    diagram = F.concat(
        F.lit('{"diagram_type":"flow","nodes":[{"id":"n1"},{"id":"n2"},{"id":"n'),
        (F.col("h").cast("int") % 50).cast("string"),
        F.lit('"}],"edges":[{"from":"n1","to":"n'),
        (F.col("w").cast("int") % 3).cast("string"),
        F.lit('"}]}'),
    )
    frame = b.withColumns({"kind": kind[pick], "s": s})
    return frame.withColumns(
        {
            "kind_second": F.when(F.col("s") % 7 == 3, "chart").otherwise(F.col("kind")),
            "confidence": F.when(F.col("s") % 11 != 10, F.col("score")),
            "struct": F.when(F.col("kind") == "chart", chart).when(F.col("kind") == "diagram", diagram),
        }
    )


_CROPS = """, crops AS (
  SELECT *, ['chart', 'diagram', 'table', 'equation', 'photo'][1 + (CAST(x AS INTEGER) + 10) % 5] AS kind,
         CAST(floor(score * 10) AS INTEGER) AS s, CAST(w AS INTEGER) AS wi, CAST(h AS INTEGER) AS hi FROM boxes),
read AS (
  SELECT *, CASE WHEN s % 7 = 3 THEN 'chart' ELSE kind END AS kind_second,
         CASE WHEN s % 11 <> 10 THEN score END AS confidence,
         kind = 'chart' AND wi % 4 IN (0, 2) AND hi % 20 <> 0 AS chart_bad,
         kind = 'diagram' AND wi % 3 = 0 AND hi % 50 <> 0 AS diagram_bad
  FROM crops)"""
_REASON = f"""CASE WHEN {_X1} <= {_X0} OR {_Y1} <= {_Y0} THEN 'empty_crop'
  WHEN CAST({_X1} - {_X0} AS DOUBLE) * ({_Y1} - {_Y0}) / 5000 > 0.85 THEN 'oversize'
  WHEN kind = 'photo' THEN 'reject_kind' WHEN kind <> kind_second THEN 'kinds_disagree'
  WHEN confidence IS NULL OR confidence < 0.55 THEN 'low_confidence'
  WHEN chart_bad THEN 'chart_inconsistent' WHEN diagram_bad THEN 'diagram_inconsistent' END"""


@query(
    "p6_crop_gate",
    ctes("boxes", _CROPS + f" SELECT frame_id, box_index, kind, {_REASON} AS reject_reason FROM read"),
)
def p6(spark, folder):
    return crops(spark, folder).select(
        "frame_id", "box_index", "kind", gates.crop_reason().alias("reject_reason")
    )


@query(
    "r5_double_read",
    ctes("boxes", _CROPS + " SELECT frame_id, box_index, kind = kind_second AS agrees FROM read"),
)
def r5(spark, folder):
    return crops(spark, folder).select(
        "frame_id", "box_index", F.col("kind").eqNullSafe(F.col("kind_second")).alias("agrees")
    )


def _charts(spark, folder):
    return crops(spark, folder).where("kind = 'chart'").withColumn("chart", F.from_json("struct", structs.CHART))


def _diagrams(spark, folder):
    return crops(spark, folder).where("kind = 'diagram'").withColumn(
        "diagram", F.from_json("struct", structs.DIAGRAM)
    )


@query(
    "p7_chart_consistency",
    ctes("boxes", _CROPS + " SELECT frame_id, box_index, NOT chart_bad AS consistent FROM read WHERE kind = 'chart'"),
)
def p7(spark, folder):
    return _charts(spark, folder).select(
        "frame_id", "box_index", (~structs.chart_contradicts_insight(F.col("chart"))).alias("consistent")
    )


@query(
    "p8_diagram_consistency",
    ctes("boxes", _CROPS + " SELECT frame_id, box_index, NOT diagram_bad AS consistent FROM read WHERE kind = 'diagram'"),
)
def p8(spark, folder):
    return _diagrams(spark, folder).select(
        "frame_id", "box_index", structs.diagram_is_consistent(F.col("diagram")).alias("consistent")
    )


@query(
    "p9_chart_information",
    ctes("boxes", _CROPS + " SELECT frame_id, box_index, wi % 2 = 1 OR hi % 20 <> 0 AS informative FROM read WHERE kind = 'chart'"),
)
def p9(spark, folder):
    return _charts(spark, folder).select(
        "frame_id", "box_index",
        structs.chart_is_informative(F.col("chart.chart_type"), structs.chart_values(F.col("chart"))).alias("informative"),
    )


@query(
    "p10_diagram_density",
    ctes("boxes", _CROPS + " SELECT frame_id, box_index, true AS dense FROM read WHERE kind = 'diagram'"),
)
def p10(spark, folder):
    return _diagrams(spark, folder).select(
        "frame_id", "box_index", structs.diagram_is_dense(F.col("diagram.nodes")).alias("dense")
    )


@query(
    "f19_series_normal_form",
    ctes(
        "boxes",
        _CROPS
        + """ SELECT frame_id, box_index, 1 AS n_series, 3 AS n_points, '1,2,' AS xs,
               CAST(wi + wi + hi % 20 + wi AS DOUBLE) AS y_sum FROM read WHERE kind = 'chart'""",
    ),
)
def f19(spark, folder):
    ys = F.flatten(F.transform(F.col("series"), lambda s: s["ys"]))
    xs = F.transform(F.flatten(F.transform(F.col("series"), lambda s: s["xs"])), lambda x: F.coalesce(x, F.lit("")))
    return (
        _charts(spark, folder)
        .withColumn("struct", F.regexp_replace("struct", '"x":3,', ""))
        .withColumn("series", structs.normal_series(F.from_json("struct", structs.CHART)["series"]))
        .select(
            "frame_id", "box_index", F.size("series").alias("n_series"), F.size(ys).alias("n_points"),
            F.array_join(xs, ",").alias("xs"), F.aggregate(ys, F.lit(0.0), lambda a, y: a + y).alias("y_sum"),
        )
    )


@query(
    "a22_bar_spread",
    ctes(
        "boxes",
        _CROPS
        + " SELECT frame_id, box_index, (wi + hi % 20) / wi >= 3 AS broken_axis FROM read WHERE kind = 'chart' AND wi % 2 = 1",
    ),
)
def a22(spark, folder):
    # Values of a crop differ less than in real charts, so the ratio is 3 instead of 12.
    bars = _charts(spark, folder).where("chart.chart_type = 'bar'")
    ys = structs.chart_values(F.col("chart"))
    return bars.select(
        "frame_id", "box_index", structs.bar_spread(F.size("chart.series"), ys, 3.0).alias("broken_axis")
    )


@query(
    "f20_value_labels",
    """SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
         ELSE printf('%.4g', o_totalprice) END AS label FROM orders""",
)
def f20(spark, folder):
    return load(spark, folder, "orders").select(
        "o_orderkey", timeline.value_label(F.col("o_totalprice")).alias("label")
    )


def _tables(spark, folder):
    line = load(spark, folder, "lineitem")
    cells = F.array_repeat("l_returnflag", F.col("l_linenumber"))
    headers = F.array_repeat(F.lit("h"), (F.col("l_partkey") % 5).cast("int"))
    return line.select("l_orderkey", "l_partkey", headers.alias("headers"), F.array(cells).alias("rows"), cells.alias("row"))


@query(
    "p11_usable_tables",
    "SELECT l_partkey % 5 > 0 AS usable, count(*) AS n_tables FROM lineitem GROUP BY 1",
)
def p11(spark, folder):
    usable = structs.table_is_usable(F.col("headers"), F.col("rows"))
    return _tables(spark, folder).groupBy(usable.alias("usable")).agg(F.count(F.lit(1)).alias("n_tables"))


@query(
    "f21_fitted_rows",
    """SELECT l_partkey % 5 AS width, l_linenumber,
         array_to_string(list_transform(range(0, l_partkey % 5), lambda i: CASE WHEN i < l_linenumber THEN l_returnflag ELSE '' END), '|') AS cells,
         count(*) AS n_rows
       FROM lineitem GROUP BY ALL""",
)
def f21(spark, folder):
    width = F.size("headers")
    fitted = F.array_join(structs.fit_row(F.col("row"), width), "|")
    return (
        _tables(spark, folder)
        .groupBy(width.cast("bigint").alias("width"), F.size("row").alias("l_linenumber"), fitted.alias("cells"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


# --- figures: confidence from the frames ----------------------------------------------------

_CONF = "quality_score / 500"


def _figures(spark, folder):
    return frames(spark, folder).withColumn("confidence", F.col("quality_score") / 500)


@query(
    "p12_low_confidence_flag",
    ctes("frames", f"SELECT video_id, ord, CASE WHEN {_CONF} < 0.7 THEN 'unverified' ELSE 'pending' END AS verification_status FROM frames"),
)
def p12(spark, folder):
    return _figures(spark, folder).select(
        "video_id", "ord", gates.confidence_status(F.col("confidence")).alias("verification_status")
    )


@query(
    "p21_confidence_tiers",
    ctes("frames", f"SELECT video_id, ord, CASE WHEN {_CONF} >= 0.85 THEN 'verified' WHEN {_CONF} >= 0.55 THEN 'unverified' ELSE 'dropped' END AS tier FROM frames"),
)
def p21(spark, folder):
    return _figures(spark, folder).select("video_id", "ord", gates.confidence_tier(F.col("confidence")).alias("tier"))


@query(
    "p14_keyframe_figures",
    ctes("slides", "SELECT video_id, ord, 'keyframe' AS kind, quality_score FROM slides WHERE is_slide AND NOT contains_graph AND NOT contains_equation"),
)
def p14(spark, folder):
    return gates.keyframe_figures(slides(spark, folder).where("is_slide")).select(
        "video_id", "ord", "kind", "quality_score"
    )


@query(
    "u4_keyframes_and_crops",
    ctes(
        "slides",
        """SELECT video_id, ord, 'keyframe' AS kind, -1 AS box_index FROM slides WHERE is_slide AND NOT contains_graph AND NOT contains_equation
           UNION ALL
           SELECT video_id, ord, CASE WHEN contains_equation THEN 'equation' ELSE 'chart' END, CAST(phash % 4 AS INTEGER)
           FROM slides WHERE is_slide AND (contains_graph OR contains_equation)""",
    ),
)
def u4(spark, folder):
    chosen = slides(spark, folder).where("is_slide")
    whole = gates.keyframe_figures(chosen).withColumn("box_index", F.lit(-1))
    cut = chosen.where("contains_graph or contains_equation").withColumns(
        {
            "kind": F.when(F.col("contains_equation"), "equation").otherwise("chart"),
            "box_index": (F.col("phash") % 4).cast("int"),
        }
    )
    return whole.unionByName(cut).select("video_id", "ord", "kind", "box_index")


@query(
    "p22_outside_axis",
    ctes("frames", "SELECT video_id, ord, quality_score < 50 OR quality_score + phash > 450 AS outside FROM frames"),
)
def p22(spark, folder):
    ys = F.array(F.col("quality_score"), F.col("quality_score") + F.col("phash"))
    return frames(spark, folder).select(
        "video_id", "ord", gates.outside_axis(ys, F.lit(50.0), F.lit(450.0)).alias("outside")
    )


@query(
    "p23_readings_agree",
    """SELECT p_partkey, round(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS share,
         levenshtein(p_brand, 'Brand#1') / greatest(length(p_brand), 7) < 0.10 AS agrees FROM part""",
)
def p23(spark, folder):
    return load(spark, folder, "part").select(
        "p_partkey",
        F.round(edit_share(F.col("p_name"), F.col("p_type")), 6).alias("share"),
        gates.readings_agree(F.col("p_brand"), F.lit("Brand#1")).alias("agrees"),
    )
