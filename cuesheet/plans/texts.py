"""Queries over texts: deck type, sentences, clipping, provenance, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.operators import classify, replies
from cuesheet.operators.windows import longest_id_run
from cuesheet.plans.bindings import events
from cuesheet.plans.gating import RELEVANCE, relevance
from cuesheet.plans.registry import load, query

# --- deck types -----------------------------------------------------------------------------

# The source's heuristic looks at this much of a transcript.
SAMPLE_CHARS = 4000


def _items(spark, folder):
    return load(spark, folder, "documents").select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat("lang", F.lit(" best tutorial news")).alias("description"),
        F.col("text").alias("transcript"),
    )


def _hits(column: str, words: list[str]) -> str:
    quoted = ["contains({}, '{}')::INT".format(column, w.replace("'", "''")) for w in words]
    return "(" + " + ".join(quoted) + ")"


def _score(deck_type: str) -> str:
    words = classify.WORDS[deck_type]
    score = f"{_hits('t', words)} * 3 + {_hits('d', words)} * 2 + {_hits('s', words)}"
    if deck_type == "listicle":
        score += r" + CASE WHEN regexp_matches(title, '(?i)\b(?:top\s*)?\d{1,2}\b|\d{1,2}\s*(?:가지|개|선|위)') THEN 3 ELSE 0 END"
    if deck_type == "interview":
        score += " + CASE WHEN length(sample) - length(replace(sample, '?', '')) >= 8 THEN 2 ELSE 0 END"
    return f"CAST({score} AS INTEGER) AS {deck_type}"


def _scores(source: str) -> str:
    return f"""WITH items AS ({source}),
low AS (SELECT *, lower(title) AS t, lower(description) AS d, left(transcript, 4000) AS sample, lower(left(transcript, 4000)) AS s FROM items),
scores AS (SELECT doc_id, {', '.join(_score(t) for t in classify.DECK_TYPES)} FROM low)
"""


_DOCS = "SELECT doc_id, split_part(text, chr(10), 1) AS title, lang || ' best tutorial news' AS description, text AS transcript FROM documents"
_PAGES = "SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url AS description, html AS transcript FROM pages"
_LIST = "[" + ", ".join(f"struct_pack(neg := -{t}, rank := {i}, type := '{t}')" for i, t in enumerate(classify.DECK_TYPES)) + "]"
_PICK = f""", ranked AS (SELECT *, list_sort({_LIST}) AS r, {' + '.join(classify.DECK_TYPES)} AS total FROM scores),
tops AS (SELECT doc_id, r[1].type AS top_type, -r[1].neg AS top, -r[2].neg AS second, total FROM ranked),
picked AS (SELECT doc_id, CASE WHEN top = 0 THEN 'explainer' ELSE top_type END AS type,
  CASE WHEN top = 0 THEN 0.2::DOUBLE ELSE round(least(1.0::DOUBLE, top / total * 0.6::DOUBLE + (top - second) / top * 0.4::DOUBLE), 2) END AS confidence FROM tops)
"""


@query("a10_type_scores", _scores(_DOCS) + "SELECT * FROM scores")
def a10(spark, folder):
    return classify.type_scores(_items(spark, folder), SAMPLE_CHARS).select("doc_id", "scores.*")


@query("a11_pick_type", _scores(_DOCS) + _PICK + "SELECT * FROM picked")
def a11(spark, folder):
    return classify.pick_type(classify.type_scores(_items(spark, folder), SAMPLE_CHARS)).select("doc_id", "type", "confidence")


@query("a11_page_types", _scores(_PAGES) + _PICK + "SELECT * FROM picked")
def a11_pages(spark, folder):
    p = load(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").alias("description"),
        F.col("html").alias("transcript"),
    )
    return classify.pick_type(classify.type_scores(p, SAMPLE_CHARS)).select("doc_id", "type", "confidence")


@query(
    "a13_route_types",
    _scores(_DOCS)
    + _PICK
    + """, opinions AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'story' ELSE 'essay' END AS second_type, CASE WHEN toxic = 0 THEN 0.9::DOUBLE END AS second_confidence FROM labels)
SELECT p.doc_id, CASE WHEN p.confidence < 0.45 AND o.second_type = 'story' THEN 'story' ELSE p.type END AS routed_type,
  CASE WHEN p.confidence < 0.45 AND o.doc_id IS NOT NULL THEN coalesce(o.second_confidence, p.confidence) ELSE p.confidence END AS routed_confidence,
  CASE WHEN p.confidence >= 0.45 THEN 'heuristic' WHEN o.doc_id IS NOT NULL THEN 'second' ELSE 'heuristic(fallback)' END AS source
FROM picked p LEFT JOIN opinions o ON p.doc_id = o.doc_id""",
)
def a13(spark, folder):
    picked = classify.pick_type(classify.type_scores(_items(spark, folder), SAMPLE_CHARS)).select("doc_id", "type", "confidence")
    opinions = load(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "story").otherwise("essay").alias("second_type"),
        F.when(F.col("toxic") == 0, F.lit(0.9)).alias("second_confidence"),
    )
    return classify.route(picked, opinions, "doc_id").select(
        "doc_id", "routed_type", "routed_confidence", "source"
    )


_TYPE_OF = "['explainer', 'howto', 'review', 'interview', 'news', 'listicle', 'story', 'talk']"


@query(
    "a21_collection_type",
    f"""WITH videos AS (SELECT n_regionkey AS collection_id, {_TYPE_OF}[1 + c_custkey % 8] AS type, c_custkey % 8 AS rank, {RELEVANCE} AS relevance_pct
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
votes AS (SELECT collection_id, type, rank, CAST(sum(relevance_pct) AS BIGINT) AS weight FROM videos GROUP BY ALL)
SELECT collection_id, type, weight FROM votes QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY weight DESC, rank) = 1""",
)
def a21(spark, folder):
    kinds = F.array(*[F.lit(t) for t in classify.DECK_TYPES])
    nation = load(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("collection_id")
    )
    videos = load(spark, folder, "customer").join(nation, "c_nationkey").select(
        "collection_id", kinds[(F.col("c_custkey") % 8).cast("int")].alias("type"), relevance().alias("relevance_pct")
    )
    return classify.collection_type(videos, "collection_id")


# --- sentences and clipping -----------------------------------------------------------------


@query(
    "f11_first_sentence",
    r"""SELECT doc_id, left(split_part(regexp_replace(text, '([.!?。])\s', '\1' || chr(1), 'g'), chr(1), 1), 90) AS sentence FROM documents""",
)
def f11(spark, folder):
    return load(spark, folder, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query(
    "f12_clipped_titles",
    """WITH cut AS (SELECT doc_id, replace(text, chr(10), ' ') AS t, left(replace(text, chr(10), ' '), 40) AS c FROM documents),
spaced AS (SELECT *, CASE WHEN contains(c, ' ') THEN length(c) - instr(reverse(c), ' ') ELSE -1 END AS sp FROM cut)
SELECT doc_id, CASE WHEN length(t) <= 40 THEN t ELSE trim(CASE WHEN sp > 24 THEN left(c, sp) ELSE c END) END AS title FROM spaced""",
)
def f12(spark, folder):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    return load(spark, folder, "documents").select("doc_id", text.clip_words(flat, 40).alias("title"))


_PROV = (
    r"(?:이|본|그)\s*영상[^\s,.]*[\s,]*|영상\s*에서[^\s,.]*[\s,]*|본\s*강의[^\s,.]*[\s,]*"
    r"|강사님?[^\s,.]*[\s,]*|채널\s*구독[^\s,.]*\s*|구독.{0,8}좋아요\s*"
)


@query(
    "f13_subject_text",
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(
           nfc_normalize('이 영상에서는 ' || nfd || '  구독과 좋아요 cafe' || chr(769)), '{_PROV}', '', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest,
         length(regexp_replace(regexp_replace(regexp_replace(
           nfc_normalize('이 영상에서는 ' || nfd || '  구독과 좋아요 cafe' || chr(769)), '{_PROV}', '', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS n_chars
       FROM (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) AS nfd FROM documents)""",
)
def f13(spark, folder):
    accent = F.lit("é")
    raw = F.concat(F.lit("이 영상에서는 "), F.replace("text", F.lit("é"), accent), F.lit("  구독과 좋아요 café"))
    clean = text.subject_text(raw)
    return load(spark, folder, "documents").select("doc_id", clean.alias("t")).select(
        "doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars")
    )


@query(
    "f16_meta_hits",
    r"""WITH hits AS (SELECT page_id, regexp_extract(html, '(?i)이\s*영상|영상\s*에서(?:는)?|본\s*강의|강사(?:님)?|채널\s*구독|구독.{0,15}좋아요|출처\s*영상|동반\s*별첨|별첨|VIDEO\s*DIGEST|채널명') AS phrase,
         regexp_extract(html, '\b\d{1,2}:\d{2}\b') AS clock FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || ' Video Digest' WHEN 1 THEN html || ' at 12:45' ELSE html END AS html FROM pages))
SELECT page_id, CASE WHEN phrase <> '' THEN phrase WHEN clock <> '' THEN clock END AS hit FROM hits""",
)
def f16(spark, folder):
    n = F.col("page_id") % 4
    body = F.when(n == 0, F.concat("html", F.lit(" Video Digest"))).when(
        n == 1, F.concat("html", F.lit(" at 12:45"))
    ).otherwise(F.col("html"))
    return load(spark, folder, "pages").select("page_id", text.meta_hit(body).alias("hit"))


@query(
    "f17_question_and_ranking",
    r"""SELECT doc_id, CAST(length(text) - length(replace(text, '?', '')) AS INTEGER) AS questions,
         regexp_matches(text, '(?i)\b(?:top\s*)?\d{1,2}\b|\d{1,2}\s*(?:가지|개|선|위)') AS ranking FROM documents""",
)
def f17(spark, folder):
    return load(spark, folder, "documents").select(
        "doc_id", text.question_count(F.col("text")).alias("questions"),
        text.has_ranking_number(F.col("text")).alias("ranking"),
    )


@query(
    "f18_narrative_sentences",
    r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…다])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 12) AS parts FROM conversations)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS sentence FROM s, unnest(range(1, len(parts) + 1)) AS g(i)""",
)
def f18(spark, folder):
    return load(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(text.narrative_sentences(F.col("text"))).alias("pos", "sentence")
    )


# --- replies: JSON built from orders and events ---------------------------------------------


def _replies(spark, folder, exact: bool):
    o = load(spark, folder, "orders")
    n = (F.col("o_orderkey") % 4 + 1).cast("int")
    m = F.when(F.col("o_custkey") % 3 == 0, n).otherwise((F.col("o_custkey") % 6).cast("int"))
    item = lambda i: F.struct(
        F.when((F.col("o_orderkey") + i) % 3 != 0, (F.col("o_custkey") + i) % 2 == 0).alias("is_slide"),
        F.when((F.col("o_orderkey") + i) % 2 == 0, F.lit("chart")).otherwise("poster").alias("frame_type"),
        F.when(i > 0, i / 10).alias("confidence"),
    )
    items = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), item)).otherwise(
        F.array().cast("array<struct<is_slide:boolean,frame_type:string,confidence:double>>")
    )
    body = F.to_json(items)
    if exact:
        raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    else:
        raw = F.concat(F.lit("Sure: "), body, F.lit(" done"))
    return o.select(
        F.col("o_orderkey").alias("reply_id"), n.alias("n_frames"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("no answer")).otherwise(raw).alias("raw"),
    )


_REPLY = """WITH r AS (SELECT o_orderkey AS reply_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS n,
    CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 4 + 1 ELSE o_custkey % 6 END AS m, o_orderkey AS k, o_custkey AS c FROM orders),
rows AS (SELECT reply_id, n, m, CAST(i AS INTEGER) AS frame_pos,
    CASE WHEN i < m AND (k + i) % 3 <> 0 THEN (c + i) % 2 = 0 ELSE false END AS is_slide,
    CASE WHEN i < m AND (k + i) % 2 = 0 THEN 'chart' ELSE 'b_roll' END AS frame_type,
    CASE WHEN i < m AND i > 0 THEN i / 10 ELSE 0 END AS confidence FROM r, unnest(range(0, n)) AS g(i))
"""


@query(
    "r1_routing_rows",
    _REPLY + "SELECT reply_id, frame_pos, is_slide, frame_type, round(confidence, 6)::DOUBLE AS confidence FROM rows WHERE reply_id % 11 <> 0",
)
def r1(spark, folder):
    good, _ = replies.routing_rows(_replies(spark, folder, exact=False))
    return good.select("reply_id", "frame_pos", "is_slide", "frame_type", F.round("confidence", 6).alias("confidence"))


@query("r1_reply_quarantine", "SELECT o_orderkey AS reply_id FROM orders WHERE o_orderkey % 11 = 0")
def r1_bad(spark, folder):
    return replies.routing_rows(_replies(spark, folder, exact=False))[1].select("reply_id")


@query(
    "p19_routing_defaults",
    _REPLY
    + """SELECT frame_type, is_slide, false AS contains_graph, count(*) AS n_rows FROM rows WHERE reply_id % 11 <> 0 GROUP BY ALL""",
)
def p19(spark, folder):
    good, _ = replies.routing_rows(_replies(spark, folder, exact=False))
    return good.groupBy("frame_type", "is_slide", "contains_graph").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "r2_strict_rows",
    _REPLY + "SELECT reply_id, frame_pos, is_slide, frame_type FROM rows WHERE reply_id % 11 <> 0 AND n = m",
)
def r2(spark, folder):
    good, _ = replies.strict_rows(_replies(spark, folder, exact=True))
    return good.select("reply_id", "frame_pos", "is_slide", "frame_type")


@query(
    "r2_strict_quarantine",
    """SELECT o_orderkey AS reply_id, CASE WHEN o_orderkey % 11 = 0 THEN 'not_an_array' ELSE 'length_mismatch' END AS reject_reason
       FROM orders WHERE o_orderkey % 11 = 0 OR (o_custkey % 3 <> 0 AND o_custkey % 6 <> o_orderkey % 4 + 1)""",
)
def r2_bad(spark, folder):
    return replies.strict_rows(_replies(spark, folder, exact=True))[1].select("reply_id", "reject_reason")


def _diagram_replies(spark, folder):
    """Diagram replies, two thirds of them cut somewhere; most are small, every eighth has up to 40 nodes."""
    o = load(spark, folder, "orders")
    n = F.when(F.col("o_orderkey") % 8 == 0, F.col("o_custkey") % 40 + 1).otherwise(F.col("o_custkey") % 9 + 1).cast("int")
    step = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(3)
    node = lambda i: F.struct(
        F.concat(F.lit("Q"), (F.col("o_orderkey") + i * step).cast("string")).alias("id"), F.lit('a "b" ]').alias("label")
    )
    doc = F.struct(F.lit("diagram").alias("kind"), F.struct(F.transform(F.sequence(F.lit(1), n), node).alias("nodes")).alias("struct"))
    body = F.to_json(doc)
    keep = F.when(F.col("o_orderkey") % 3 == 0, F.length(body)).otherwise(
        (F.length(body) - 1 - F.col("o_orderkey") % 37).cast("int")
    )
    return o.select(
        F.col("o_orderkey").alias("reply_id"),
        F.substring(body, F.lit(1), keep).alias("raw"),
        F.when(F.col("o_orderkey") % 3 == 1, "length").otherwise("stop").alias("finish_reason"),
    )


# A cut reply keeps its complete nodes; each ends in the only quote-brace of its text.
_CUT = r"""WITH shaped AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 0 THEN o_custkey % 40 + 1 ELSE o_custkey % 9 + 1 END AS n,
    CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END AS step FROM orders),
listed AS (SELECT *, list_transform(range(1, n + 1), lambda i: '{"id":"Q' || (k + i * step) || '","label":"a \"b\" ]"}') AS nodes FROM shaped),
full_text AS (SELECT *, '{"kind":"diagram","struct":{"nodes":[' || array_to_string(nodes, ',') || ']}}' AS body FROM listed),
cut AS (SELECT *, CASE WHEN k % 3 = 0 THEN body ELSE left(body, length(body) - 1 - k % 37) END AS raw FROM full_text),
counted AS (SELECT *, (length(raw) - length(replace(raw, '"}', ''))) // 2 AS m FROM cut),
salvaged AS (SELECT k AS reply_id, m, step, CASE WHEN k % 3 = 0 THEN 'complete' WHEN k % 3 = 1 AND m > 0 THEN 'salvaged' ELSE 'unreadable' END AS outcome,
    CASE WHEN k % 3 = 0 THEN body WHEN k % 3 = 1 AND m > 0 THEN '{"kind":"diagram","struct":{"nodes":[' || array_to_string(nodes[1:m], ',') || ']}}' END AS doc FROM counted)
"""


@query("r3_salvage_truncated", _CUT + "SELECT reply_id, doc, outcome FROM salvaged")
def r3(spark, folder):
    return replies.salvage_truncated(_diagram_replies(spark, folder))


@query(
    "r4_overgenerated",
    _CUT + "SELECT reply_id, outcome, outcome = 'salvaged' AND (m > 30 OR (step = 1 AND m >= 6)) AS overgenerated FROM salvaged",
)
def r4(spark, folder):
    return replies.overgenerated(replies.salvage_truncated(_diagram_replies(spark, folder))).select(
        "reply_id", "outcome", "overgenerated"
    )


@query(
    "w6_longest_id_run",
    """WITH ids AS (SELECT DISTINCT user_id, event_type AS prefix, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS n FROM events),
islands AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, prefix ORDER BY n) AS island FROM ids),
lengths AS (SELECT user_id, prefix, island, count(*) AS length FROM islands GROUP BY ALL)
SELECT user_id, max(length) AS longest_run, 0::BIGINT AS overlong FROM lengths GROUP BY user_id""",
)
def w6(spark, folder):
    ids = events(spark, folder).select(
        "user_id", F.concat("event_type", F.regexp_extract("props", "[0-9]+", 0)).alias("node_id")
    )
    return longest_id_run(ids, ["user_id"])


@query(
    "f23_stat_rows",
    """WITH d AS (SELECT *, o_orderkey % 6 AS m FROM orders)
SELECT o_orderkey, 0 AS pos, 'price' AS label, o_orderstatus AS value FROM d WHERE m = 0
UNION ALL SELECT o_orderkey, 1, 'rank', CAST(o_custkey AS VARCHAR) FROM d WHERE m = 0
UNION ALL SELECT o_orderkey, 0, '', o_orderstatus FROM d WHERE m = 1
UNION ALL SELECT o_orderkey, 1, '', CAST(o_custkey AS VARCHAR) FROM d WHERE m = 1
UNION ALL SELECT o_orderkey, 2, 'users', '5' FROM d WHERE m = 1
UNION ALL SELECT o_orderkey, 0, 'a', CAST(o_custkey AS VARCHAR) FROM d WHERE m IN (2, 4)
UNION ALL SELECT o_orderkey, 1, '', 'x' FROM d WHERE m IN (2, 4)""",
)
def f23(spark, folder):
    status, cust = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    shapes = [
        F.concat(F.lit('{"metrics": {"price": "'), status, F.lit('", "rank": '), cust, F.lit(', "deep": {"x": 1}}}')),
        F.concat(F.lit('{"metrics": ["'), status, F.lit('", '), cust, F.lit(', {"users": 5}, {"a": 1, "b": 2}, [1], {"n": {"x": 1}}]}')),
        F.concat(F.lit('```json\n{"metrics": [{"label": "a", "value": '), cust, F.lit('}, {"value": "x"}]}\n```')),
        F.lit('{"metrics": "bare"}'),
        F.concat(F.lit('Here: {"metrics": [{"label": "a", "value": '), cust, F.lit('}, {"value": "x"}]} ok')),
        F.lit("no document"),
    ]
    raw = shapes[5]
    for m in range(4, -1, -1):
        raw = F.when(F.col("o_orderkey") % 6 == m, shapes[m]).otherwise(raw)
    return replies.stat_rows(load(spark, folder, "orders").select("o_orderkey", raw.alias("raw")), "o_orderkey")
