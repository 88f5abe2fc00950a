"""Queries over job logs, run reports, deck tables and ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuesheet.functions import text, timeline
from cuesheet.operators import gates, jobs
from cuesheet.plans.bindings import ctes, events, flagged, frames, job_events, job_events_of, loose_frames
from cuesheet.plans.registry import load, query
from cuesheet.session import shared_folder, stored
from cuesheet.sources import readers, sinks
from cuesheet.sources.store import Change, Store
from cuesheet.streaming.jobs import read_job_state, start_job_state

# --- job state ------------------------------------------------------------------------------

_STATE = """, state AS (
  SELECT job_id,
    arg_max(CASE WHEN event = 'create' THEN 'acquire' ELSE stage END, seq) FILTER (event IN ('create', 'enter')) AS stage,
    arg_max(CASE event WHEN 'create' THEN 'queued' WHEN 'enter' THEN 'running' WHEN 'complete' THEN 'done' ELSE 'error' END, seq) AS status,
    arg_max(struct_pack(v := CASE WHEN event = 'enter' THEN timeout_us END), seq).v AS timeout_us,
    arg_max(attempt_count, seq) FILTER (attempt_count IS NOT NULL) AS attempt_count,
    (arg_max(struct_pack(v := CASE WHEN event = 'fail' THEN last_error END), seq) FILTER (event IN ('complete', 'fail'))).v AS last_error,
    arg_max(stage, seq) FILTER (event = 'fail') AS failure_stage,
    max(event_us) AS event_us, max(seq) AS seq
  FROM job_events GROUP BY job_id)"""


@query("a12_job_state", ctes("job_events", _STATE + " SELECT * FROM state"))
def a12(spark, folder):
    return jobs.job_state(job_events(spark, folder))


def _streamed(spark, folder, late):
    """Store with the job states of the whole log, streamed."""
    schema = load(spark, folder, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        .withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    )
    base = f"{shared_folder(spark)}/job-state-{uuid.uuid4().hex}"
    store = Store(spark, f"{base}/store", 8)
    start_job_state(job_events_of(stream), store, f"{base}/progress", True, late, 36500).awaitTermination()
    return store


_TEN_YEARS = "3650 days"


@query("t1_job_state_stream", ctes("job_events", _STATE + " SELECT * FROM state"))
def t1(spark, folder):
    # Event time stays behind every deadline, so these are the states themselves.
    return read_job_state(_streamed(spark, folder, _TEN_YEARS)).drop("timed_out")


@query(
    "t2_timeout_timers",
    ctes(
        "job_events",
        _STATE
        + """, clock AS (SELECT max(event_us) // 1000 AS now_ms FROM job_events),
late AS (SELECT *, coalesce(status = 'running' AND now_ms > timeout_us // 1000, false) AS timed_out FROM state, clock)
SELECT job_id, stage, CASE WHEN timed_out THEN 'error' ELSE status END AS status,
       CASE WHEN timed_out THEN 'timeout' ELSE last_error END AS last_error,
       CASE WHEN timed_out THEN stage ELSE failure_stage END AS failure_stage, timed_out FROM late""",
    ),
)
def t2_timers(spark, folder):
    # Event time ends at the newest event of the log.
    states = read_job_state(_streamed(spark, folder, "0 seconds"))
    return states.select("job_id", "stage", "status", "last_error", "failure_stage", "timed_out")


_AS_OF = 1705000000000000


@query(
    "t2_timeout_sweep",
    ctes(
        "job_events",
        _STATE
        + f""", late AS (SELECT *, coalesce(status = 'running' AND {_AS_OF} > timeout_us, false) AS timed_out FROM state)
SELECT job_id, stage, CASE WHEN timed_out THEN 'error' ELSE status END AS status,
       CASE WHEN timed_out THEN 'timeout' ELSE last_error END AS last_error,
       CASE WHEN timed_out THEN stage ELSE failure_stage END AS failure_stage, timed_out FROM late""",
    ),
)
def t2(spark, folder):
    swept = jobs.timeout_sweep(jobs.job_state(job_events(spark, folder)), F.lit(_AS_OF))
    return swept.select("job_id", "stage", "status", "last_error", "failure_stage", "timed_out")


@query(
    "p20_timed_out",
    ctes("job_events", _STATE + f" SELECT job_id, timeout_us FROM state WHERE status = 'running' AND timeout_us < {_AS_OF}"),
)
def p20(spark, folder):
    state = jobs.job_state(job_events(spark, folder))
    late = gates.timed_out(F.col("status"), F.col("timeout_us"), F.lit(_AS_OF))
    return state.where(late).select("job_id", "timeout_us")


@query(
    "k6_job_log",
    ctes(
        "job_events",
        """SELECT job_id, seq, event_us, event, CASE WHEN event = 'create' THEN 'acquire' WHEN event <> 'complete' THEN stage END AS stage,
             timeout_us, attempt_count, last_error FROM job_events""",
    ),
)
def k6(spark, folder):
    log = job_events(spark, folder)
    created = log.where("event = 'create'").withColumn("stage", F.lit(gates.JOB_STAGES[0]))
    parts = [
        jobs.log_rows(created.select("job_id", "seq", "event_us", "stage"), "create"),
        jobs.log_rows(log.where("event = 'enter'").select("job_id", "seq", "event_us", "stage", "timeout_us"), "enter"),
        jobs.log_rows(log.where("event = 'complete'").select("job_id", "seq", "event_us", "attempt_count"), "complete"),
        jobs.log_rows(
            log.where("event = 'fail'").select("job_id", "seq", "event_us", "stage", "attempt_count", "last_error"), "fail"
        ),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query(
    "k7_deck_status",
    """SELECT user_id AS deck_id, arg_max(event_type, event_id) AS status,
         arg_max(struct_pack(v := CASE WHEN event_type = 'error' THEN props END), event_id).v AS error FROM events GROUP BY user_id""",
)
def k7(spark, folder):
    changes = events(spark, folder).select(
        F.col("user_id").alias("deck_id"), F.col("us").alias("event_us"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )
    return jobs.deck_status(changes)


_ALIASED = """CASE WHEN stage_in = 'recognize' THEN 'numerize' WHEN stage_in IN ('acquire', 'keyframe', 'detect', 'select', 'numerize', 'build', 'validate') THEN stage_in END"""


@query(
    "p18_failure_stage",
    ctes("job_events", f""", named AS (SELECT seq, CASE seq % 4 WHEN 0 THEN 'recognize' WHEN 1 THEN 'upload' ELSE stage END AS stage_in FROM job_events)
SELECT seq, stage_in, {_ALIASED} AS failure_stage FROM named"""),
)
def p18(spark, folder):
    n = F.col("seq") % 4
    stage_in = F.when(n == 0, "recognize").when(n == 1, "upload").otherwise(F.col("stage"))
    return job_events(spark, folder).select(
        "seq", stage_in.alias("stage_in"), gates.failure_stage(stage_in).alias("failure_stage")
    )


@query(
    "k10_job_domain_checks",
    ctes(
        "job_events",
        """, rows AS (SELECT seq, CASE WHEN seq % 4 = 1 THEN 'upload' ELSE stage END AS stage,
  CASE WHEN seq % 6 = 5 THEN 'lost' ELSE 'running' END AS status, CASE WHEN seq % 5 = 0 THEN 'recognize' END AS failure_stage FROM job_events)
SELECT seq, concat_ws(',', CASE WHEN stage = 'upload' THEN 'stage' END, CASE WHEN status = 'lost' THEN 'status' END,
  CASE WHEN failure_stage IS NOT NULL THEN 'failure_stage' END) AS violations
FROM rows WHERE stage = 'upload' OR status = 'lost' OR failure_stage IS NOT NULL""",
    ),
)
def k10(spark, folder):
    seq = F.col("seq")
    rows = job_events(spark, folder).select(
        "seq",
        F.when(seq % 4 == 1, "upload").otherwise(F.col("stage")).alias("stage"),
        F.when(seq % 6 == 5, "lost").otherwise("running").alias("status"),
        F.when(seq % 5 == 0, "recognize").alias("failure_stage"),
        F.lit(None).cast("int").alias("max_attempts"),
    )
    _, bad = sinks.checked_jobs(rows)
    return bad.select("seq", F.array_join("violations", ",").alias("violations"))


# --- run reports ----------------------------------------------------------------------------

_RUNS = """, runs AS (
  SELECT job_id, CAST(split_part(job_id, '-', 1) AS BIGINT) % 5 AS report, bool_and(event <> 'fail') AS validate_pass,
         count(*) % 3 + 1 AS attempts, arg_min(stage, seq) FILTER (event = 'fail' AND attempt_count <> 2) AS failure_stage,
         arg_min(last_error, seq) FILTER (event = 'fail') AS error,
         count(*) FILTER (stage IN ('acquire', 'keyframe')) AS conf_below, count(*) AS conf_total
  FROM job_events GROUP BY job_id)"""


def runs(spark, folder):
    """One measured run per job; an error of two attempts is left without a stage."""
    failed = F.col("event") == "fail"
    return (
        job_events(spark, folder)
        .groupBy("job_id")
        .agg(
            F.bool_and(~failed).alias("validate_pass"),
            (F.count(F.lit(1)) % 3 + 1).alias("attempts"),
            F.min_by("stage", F.when(failed & (F.col("attempt_count") != 2), F.col("seq"))).alias("failure_stage"),
            F.min_by("last_error", F.when(failed, F.col("seq"))).alias("error"),
            F.count_if(F.col("stage").isin("acquire", "keyframe")).alias("conf_below"),
            F.count(F.lit(1)).alias("conf_total"),
        )
        .withColumn("report", F.split("job_id", "-")[0].cast("bigint") % 5)
    )


@query(
    "a3_failure_families",
    ctes(
        "job_events",
        _RUNS
        + """, named AS (SELECT report, failure_stage, error, CASE WHEN failure_stage IS NULL THEN 'none'
   WHEN failure_stage IN ('detect', 'select', 'numerize') THEN 'recognition' WHEN failure_stage IN ('build', 'validate') THEN 'build' ELSE 'other' END AS family FROM runs),
grid AS (SELECT DISTINCT report, f.family FROM runs, (VALUES ('recognition'), ('build'), ('other'), ('none')) AS f(family))
SELECT g.report, g.family, count(n.family) AS n_runs, count(*) FILTER (n.family = 'none' AND n.error IS NOT NULL) AS unattributed
FROM grid g LEFT JOIN named n ON n.report = g.report AND n.family = g.family GROUP BY g.report, g.family""",
    ),
)
def a3(spark, folder):
    return jobs.failure_families(runs(spark, folder), ["report"])


_GATES = """, gates AS (SELECT report, count(*) AS n_runs, count(*) FILTER (validate_pass) AS n_pass,
    count(*) FILTER (failure_stage IS NULL AND error IS NULL) AS n_completed,
    coalesce(avg(attempts) FILTER (failure_stage IS NULL AND error IS NULL), 0) AS mean_attempts,
    CAST(sum(conf_below) AS BIGINT) AS conf_below, CAST(sum(conf_total) AS BIGINT) AS conf_total FROM runs GROUP BY report)"""


@query(
    "a4_pass_ratio",
    ctes("job_events", _RUNS + _GATES + " SELECT report, n_runs, n_pass, round(n_pass / n_runs, 6) AS pass_ratio, n_pass / n_runs >= 0.9 AS g1_pass FROM gates"),
)
def a4(spark, folder):
    return jobs.run_gates(runs(spark, folder), ["report"]).select(
        "report", "n_runs", "n_pass", F.round("pass_ratio", 6).alias("pass_ratio"), "g1_pass"
    )


@query(
    "a5_mean_attempts",
    ctes("job_events", _RUNS + _GATES + " SELECT report, n_completed, round(mean_attempts, 6) AS mean_attempts, n_completed > 0 AND mean_attempts <= 2 AS g2_pass FROM gates"),
)
def a5(spark, folder):
    return jobs.run_gates(runs(spark, folder), ["report"]).select(
        "report", "n_completed", F.round("mean_attempts", 6).alias("mean_attempts"), "g2_pass"
    )


@query(
    "a5_with_crashed_attempts",
    ctes("job_events", _RUNS + """ SELECT report, round(coalesce(avg(attempts + coalesce(crashed, 0)) FILTER (failure_stage IS NULL AND error IS NULL), 0), 6) AS mean_attempts
FROM (SELECT *, CASE WHEN conf_total % 4 <> 0 THEN conf_below END AS crashed FROM runs) GROUP BY report"""),
)
def a5_crashed(spark, folder):
    crashed = F.when(F.col("conf_total") % 4 != 0, F.col("conf_below"))
    gates_ = jobs.run_gates(runs(spark, folder).withColumn("crashed_attempts", crashed), ["report"])
    return gates_.select("report", F.round("mean_attempts", 6).alias("mean_attempts"))


@query(
    "a6_low_confidence_share",
    ctes("frames", """, figures AS (SELECT video_id, CASE WHEN phash % 9 <> 0 THEN quality_score / 500 END AS confidence FROM frames)
SELECT video_id, count(*) FILTER (confidence < 0.7) AS conf_below, count(confidence) AS conf_total FROM figures GROUP BY video_id"""),
)
def a6(spark, folder):
    figures = loose_frames(spark, folder).withColumn(
        "confidence", F.when(F.col("phash") % 9 != 0, F.col("quality_score") / 500)
    )
    return jobs.confidence_counts(figures, ["video_id"])


@query(
    "f22_percent_text",
    ctes("job_events", _RUNS + _GATES + """ SELECT report, printf('%.1f', n_pass / n_runs * 100) || '%' AS pass_text,
       CASE WHEN n_pass % 2 = 0 THEN 'n/a' ELSE printf('%.1f', n_runs / n_pass * 100) || '%' END AS inverse_text FROM gates"""),
)
def f22(spark, folder):
    g = jobs.run_gates(runs(spark, folder), ["report"])
    odd = F.when(F.col("n_pass") % 2 == 0, 0).otherwise(F.col("n_pass"))
    return g.select(
        "report",
        text.percent_text(F.col("n_pass"), F.col("n_runs")).alias("pass_text"),
        text.percent_text(F.col("n_runs"), odd).alias("inverse_text"),
    )


@query(
    "k9_report_tables",
    ctes("job_events", _RUNS + _GATES + """ SELECT report, n_runs, n_pass, n_completed, conf_below, conf_total,
       round(conf_below / conf_total, 6) AS conf_share, n_pass / n_runs >= 0.9 AS g1_pass, n_completed > 0 AND mean_attempts <= 2 AS g2_pass FROM gates"""),
)
def k9(spark, folder):
    return jobs.run_gates(runs(spark, folder), ["report"]).select(
        "report", "n_runs", "n_pass", "n_completed", "conf_below", "conf_total",
        F.round("conf_share", 6).alias("conf_share"), "g1_pass", "g2_pass",
    )


@query(
    "a7_stage_counts",
    ctes(
        "slides",
        """SELECT video_id, count(*) AS candidates, count(*) FILTER (is_slide) AS selected, count(*) FILTER (contains_graph) AS boxed,
             count(*) FILTER (contains_graph AND phash % 2 = 1) AS charts, count(*) FILTER (contains_equation) AS formulas
           FROM slides GROUP BY video_id""",
    ),
)
def a7(spark, folder):
    every = flagged(loose_frames(spark, folder))
    figures = every.where("contains_graph or contains_equation").select(
        "video_id",
        F.col("contains_graph").alias("has_box"),
        F.when(F.col("contains_graph"), F.when(F.col("phash") % 2 == 1, '{"a":1}').otherwise("{}")).alias("struct"),
        F.when(F.col("contains_equation"), "x^2").otherwise("").alias("latex"),
    )
    return jobs.stage_counts(every, figures)


@query(
    "a19_stage_p95",
    """SELECT o_orderpriority AS stage, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1""",
)
def a19(spark, folder):
    orders = load(spark, folder, "orders").withColumnRenamed("o_orderpriority", "stage")
    return jobs.exact_quantile(
        orders, ["stage"], "o_totalprice", 0.95, F.floor(F.col("o_totalprice") / 100), "p95"
    ).select("stage", F.round("p95", 4).alias("p95"))


# Sketches are stored by stage and day and merged for the first halves of the years; the rank of the
# result is counted in the values themselves.
@query(
    "a19_sketched_p95",
    """SELECT o_orderpriority AS stage, count(o_totalprice) AS n_values, true AS within_error FROM orders
       WHERE month(o_orderdate) <= 6 GROUP BY 1""",
)
def a19_sketched(spark, folder):
    orders = load(spark, folder, "orders").withColumnRenamed("o_orderpriority", "stage")
    daily = stored(jobs.quantile_sketches(orders, ["stage", "o_orderdate"], "o_totalprice"))
    asked = F.month("o_orderdate") <= 6
    p95 = jobs.sketched_quantile(daily.where(asked), ["stage"], 0.95, "p95")
    ranks = orders.where(asked).join(p95, "stage").groupBy("stage").agg(
        F.max("n_values").alias("n_values"),
        (F.count_if(F.col("o_totalprice") < F.col("p95")) / F.max("n_values")).alias("below"),
        (F.count_if(F.col("o_totalprice") <= F.col("p95")) / F.max("n_values")).alias("to"),
    )
    near = (F.col("below") <= 0.95 + jobs.RANK_ERROR) & (F.col("to") >= 0.95 - jobs.RANK_ERROR)
    return ranks.select("stage", "n_values", near.alias("within_error"))


# --- deck tables: orders as decks, lines as slides and figures ------------------------------


def _decks(spark, folder):
    o = load(spark, folder, "orders")
    version = F.concat(F.lit("v"), (F.col("o_orderkey") % 2).cast("string"))
    base = o.select(
        F.col("o_orderkey").alias("deck_id"),
        F.format_string("%011d", F.col("o_orderkey")).alias("video_id"),
        version.alias("generator_version"),
        F.lit("ko").alias("lang"),
        timeline.deck_fingerprint(
            F.format_string("%011d", F.col("o_orderkey")), F.lit("v2"), F.col("o_orderstatus")
        ).alias("v2_fingerprint"),
        (F.col("o_custkey") % 20).alias("slide_count"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", "broken").alias("error"),
        F.col("o_custkey").alias("user_id"),
    )
    existing = base.where("deck_id % 3 <> 0")
    new = base.where("deck_id % 2 = 0").withColumns(
        {
            "lang": F.lit("en"),
            "slide_count": F.col("slide_count") + 1,
            "user_id": F.when(F.col("deck_id") % 4 == 0, F.col("user_id") + 1),
        }
    )
    return existing, new


@query(
    "k1_upsert_decks",
    """WITH base AS (SELECT o_orderkey AS deck_id, printf('%011d', o_orderkey) AS video_id, 'v' || o_orderkey % 2 AS generator_version,
  o_custkey, o_orderstatus, o_custkey % 20 AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)
SELECT video_id, generator_version, deck_id, CASE WHEN deck_id % 2 = 0 THEN 'en' ELSE 'ko' END AS lang,
  CASE WHEN deck_id % 2 = 0 THEN n + 1 ELSE n END AS slide_count, CASE WHEN deck_id % 2 = 0 THEN 'building' ELSE o_orderstatus END AS status,
  CASE WHEN deck_id % 2 = 1 AND o_orderstatus = 'F' THEN 'broken' END AS error,
  CASE WHEN deck_id % 4 = 0 THEN o_custkey + 1 WHEN deck_id % 3 <> 0 THEN o_custkey END AS user_id,
  deck_id % 2 = 0 AND deck_id % 3 = 0 AS created FROM base""",
)
def k1(spark, folder):
    return sinks.upsert_decks(*_decks(spark, folder)).drop("v2_fingerprint")


@query(
    "f6_deck_fingerprint",
    """SELECT o_orderkey, sha256(printf('%011d', o_orderkey) || ':v2:' || o_orderstatus) AS fingerprint FROM orders""",
)
def f6(spark, folder):
    key = timeline.deck_fingerprint(F.format_string("%011d", F.col("o_orderkey")), F.lit("v2"), F.col("o_orderstatus"))
    return load(spark, folder, "orders").select("o_orderkey", key.alias("fingerprint"))


@query(
    "v9_rebuild_list",
    """SELECT o_orderkey AS deck_id FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND o_orderstatus <> 'O')""",
)
def v9(spark, folder):
    from cuesheet.operators.audits import rebuild_list

    o = load(spark, folder, "orders")
    video = F.format_string("%011d", F.col("o_orderkey"))
    now = F.when(F.col("o_orderkey") % 2 == 0, "O").otherwise(F.col("o_orderstatus"))
    stored = o.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("deck_id"), timeline.deck_fingerprint(video, F.lit("v2"), F.col("o_orderstatus")).alias("v2_fingerprint")
    )
    wanted = o.select(
        F.col("o_orderkey").alias("deck_id"), timeline.deck_fingerprint(video, F.lit("v2"), now).alias("v2_fingerprint")
    )
    return rebuild_list(wanted, stored).select("deck_id")


def _lines(spark, folder):
    line = load(spark, folder, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("slide_id"), F.col("l_linenumber").alias("position"), F.lit("old").alias("origin")
    )


def _built(spark, folder, with_figures=True):
    """Store of deck tables after a build was written, and written again."""
    existing, new = _decks(spark, folder)
    store = Store(spark, f"{shared_folder(spark)}/decks-{uuid.uuid4().hex}", 16)
    lines = _lines(spark, folder)
    figures = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("slide_id"), F.col("l_suppkey").alias("figure_id"), F.lit("old").alias("origin")
    )
    ids = existing.select("deck_id")
    store.commit([
        Change("decks", existing, sinks.DECK_KEY),
        Change("slides", lines.join(ids, "deck_id", "left_semi"), ["deck_id"]),
        Change("figures", figures.join(ids, "deck_id", "left_semi"), ["deck_id"]),
    ])
    keys = new.select("deck_id", *sinks.DECK_KEY)

    def fresh(rows):
        return rows.join(keys, "deck_id").drop("deck_id").withColumn("origin", F.lit("new"))

    slides = fresh(lines.where("position <= 3").withColumn("position", F.col("position") + 100))
    for _ in range(2):
        sinks.save_decks(store, new, slides, fresh(figures.where("figure_id % 2 = 0")) if with_figures else None)
    return store


@query(
    "k1_stored_decks",
    """WITH base AS (SELECT o_orderkey AS deck_id, printf('%011d', o_orderkey) AS video_id, 'v' || o_orderkey % 2 AS generator_version,
  o_custkey, o_orderstatus, o_custkey % 20 AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)
SELECT video_id, generator_version, deck_id, CASE WHEN deck_id % 2 = 0 THEN 'en' ELSE 'ko' END AS lang,
  CASE WHEN deck_id % 2 = 0 THEN n + 1 ELSE n END AS slide_count, CASE WHEN deck_id % 2 = 0 THEN 'building' ELSE o_orderstatus END AS status,
  CASE WHEN deck_id % 2 = 1 AND o_orderstatus = 'F' THEN 'broken' END AS error,
  CASE WHEN deck_id % 4 = 0 THEN o_custkey + 1 WHEN deck_id % 3 <> 0 THEN o_custkey END AS user_id FROM base""",
)
def k1_stored(spark, folder):
    return _built(spark, folder).read("decks").drop("v2_fingerprint")


@query(
    "k2_stored_slides",
    """SELECT l_orderkey AS deck_id, l_partkey AS slide_id, CAST(l_linenumber AS INTEGER) AS position, 'old' AS origin FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey % 2 = 1
  UNION ALL SELECT l_orderkey, l_partkey, l_linenumber + 100, 'new' FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 3""",
)
def k2_stored(spark, folder):
    return _built(spark, folder).read("slides")


@query(
    "k2_stored_detached",
    """SELECT l_orderkey AS deck_id, CASE WHEN l_orderkey % 2 = 1 THEN l_partkey END AS slide_id, l_suppkey AS figure_id, 'old' AS origin
  FROM lineitem WHERE l_orderkey % 3 <> 0""",
)
def k2_stored_detached(spark, folder):
    return _built(spark, folder, with_figures=False).read("figures")


@query(
    "k3_stored_figures",
    """SELECT l_orderkey AS deck_id, l_partkey AS slide_id, l_suppkey AS figure_id, 'old' AS origin FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey % 2 = 1
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 'new' FROM lineitem WHERE l_orderkey % 2 = 0 AND l_suppkey % 2 = 0""",
)
def k3_stored(spark, folder):
    return _built(spark, folder).read("figures")


_REPLACED = """SELECT l_orderkey AS deck_id, l_partkey AS slide_id, l_linenumber AS position, 'old' AS origin FROM lineitem WHERE l_orderkey % 5 <> 0
  UNION ALL SELECT l_orderkey, l_partkey, l_linenumber + 100, 'new' FROM lineitem WHERE l_orderkey % 10 = 0"""


@query("k2_replace_slides", _REPLACED)
def k2(spark, folder):
    rebuilt = load(spark, folder, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("deck_id"))
    fresh = _lines(spark, folder).where("deck_id % 10 = 0").withColumns(
        {"position": F.col("position") + 100, "origin": F.lit("new")}
    )
    return sinks.replace_rows(_lines(spark, folder), fresh, rebuilt)


@query(
    "k2_detach_figures",
    "SELECT l_orderkey AS deck_id, CASE WHEN l_orderkey % 5 <> 0 THEN l_partkey END AS slide_id, l_linenumber AS position FROM lineitem",
)
def k2_detach(spark, folder):
    rebuilt = load(spark, folder, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("deck_id"))
    return sinks.detach_figures(_lines(spark, folder).drop("origin"), rebuilt)


@query(
    "k3_replace_figures",
    """SELECT l_orderkey AS deck_id, l_suppkey AS figure_id, l_returnflag AS kind FROM lineitem WHERE l_orderkey % 7 <> 0
       UNION ALL SELECT l_orderkey, l_suppkey + 1000000, 'N' FROM lineitem WHERE l_orderkey % 7 = 0""",
)
def k3(spark, folder):
    old = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("deck_id"), F.col("l_suppkey").alias("figure_id"), F.col("l_returnflag").alias("kind")
    )
    fresh = old.where("deck_id % 7 = 0").withColumns({"figure_id": F.col("figure_id") + 1000000, "kind": F.lit("N")})
    return sinks.replace_rows(old, fresh, fresh)


@query(
    "k4_append_keyframes",
    ctes("frames", "SELECT video_id, ord, timestamp_sec FROM frames WHERE event_type = 'click' AND quality_score <= 250"),
)
def k4(spark, folder):
    f = frames(spark, folder)
    stored = f.where("quality_score > 250")
    return sinks.unseen_keyframes(f.where("event_type = 'click'"), stored).select("video_id", "ord", "timestamp_sec")


@query(
    "k5_append_caption_segments",
    ctes("captions", "SELECT video_id, from_sec, to_sec, len(embedding) AS dims FROM captions WHERE ord % 2 = 0"),
)
def k5(spark, folder):
    from cuesheet.plans.bindings import captions

    c = captions(spark, folder)
    fresh = sinks.unseen_caption_segments(c, c.where("ord % 2 = 1"))
    return fresh.select("video_id", "from_sec", "to_sec", F.size("embedding").cast("bigint").alias("dims"))


@query(
    "k4_stored_keyframes",
    ctes("frames", """, once AS (SELECT * FROM frames WHERE quality_score > 250 OR event_type = 'click'
  QUALIFY row_number() OVER (PARTITION BY video_id, CAST(round(timestamp_sec * 1e6) AS BIGINT) ORDER BY quality_score <= 250, ord) = 1)
  SELECT video_id, ord, timestamp_sec FROM once"""),
)
def k4_stored(spark, folder):
    f = frames(spark, folder).select("video_id", "ord", "timestamp_sec", "quality_score", "event_type")
    store = Store(spark, f"{shared_folder(spark)}/keyframes-{uuid.uuid4().hex}", 16)
    first, second = f.where("quality_score > 250"), f.where("event_type = 'click'")
    # The second batch comes three times, the last one under a new name.
    for rows, batch in ((first, 1), (second, 2), (second, 2), (second, 3)):
        sinks.append_unseen(store, "keyframes", rows, sinks.KEYFRAME_KEY, ("select", batch))
    return store.read("keyframes").select("video_id", "ord", "timestamp_sec")


@query(
    "k5_stored_segments",
    ctes("captions", "SELECT video_id, from_sec, to_sec, len(embedding) AS dims FROM captions"),
)
def k5_stored(spark, folder):
    from cuesheet.plans.bindings import captions

    c = captions(spark, folder).drop("text")
    store = Store(spark, f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}", 16)
    for rows, batch in ((c.where("ord % 2 = 1"), 1), (c, 2), (c, 3)):
        sinks.append_unseen(store, "segments", rows, sinks.SEGMENT_KEY, ("captions", batch))
    return store.read("segments").select("video_id", "from_sec", "to_sec", F.size("embedding").cast("bigint").alias("dims"))


@query(
    "k8_stage_artifacts",
    """SELECT ['01-keyframes', '02-detect', '04-numerize'][1 + doc_id % 3] AS stage, 'V' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS label,
         'frame_' || lang || '.png' AS file_name, 'stored V' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' from ' || source AS message FROM documents""",
)
def k8(spark, folder):
    d = load(spark, folder, "documents").withColumn("video_id", F.format_string("vid-%07d-x", "doc_id"))
    stages = F.array(F.lit("01-keyframes"), F.lit("02-detect"), F.lit("04-numerize"))
    rows = d.select(
        stages[(F.col("doc_id") % 3).cast("int")].alias("stage"),
        F.format_string("V%06d", "doc_id").alias("label"),
        "video_id",
        F.concat(F.lit("/tmp/frames/"), "video_id", F.lit("/frame_"), "lang", F.lit(".png")).alias("path"),
        F.concat(F.lit("stored "), "video_id", F.lit(" from "), "source").alias("message"),
    )
    return sinks.artifact_rows(rows)


@query("f14_leaf_names", "SELECT page_id, regexp_extract(url, '[^/]*$') AS leaf FROM pages")
def f14(spark, folder):
    return load(spark, folder, "pages").select("page_id", text.leaf_name(F.col("url")).alias("leaf"))


@query(
    "f15_masked_messages",
    """SELECT page_id, CASE WHEN coalesce(lang, '') = '' THEN url ELSE replace(url, lang, 'V' || page_id) END AS message
       FROM (SELECT *, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages)""",
)
def f15(spark, folder):
    p = load(spark, folder, "pages").withColumn("lang", F.regexp_extract("html", 'lang="([a-z]+)"', 1))
    label = F.concat(F.lit("V"), F.col("page_id").cast("string"))
    return p.select("page_id", text.mask_video(F.col("url"), F.col("lang"), label).alias("message"))


# --- ingest: JSON text built from the given rows --------------------------------------------

_DOC_SEGMENTS = """WITH chosen AS (SELECT doc_id, doc_id // 2 AS video_id, text FROM documents WHERE doc_id % 2 = 0),
cut AS (SELECT doc_id, video_id, string_split(text, chr(10)) AS parts FROM chosen WHERE doc_id % 13 <> 0)
SELECT 'v' || video_id AS external_id, i - 1 AS ord, CAST((i - 1) * 5 AS DOUBLE) AS from_sec, CAST((i - 1) * 5 + 4 AS DOUBLE) AS to_sec, parts[i] AS text
FROM cut, unnest(range(1, len(parts) + 1)) AS g(i)"""


def _caption_rows(spark, folder):
    """Two caption rows per video, the segments as JSON text; every 13th text is cut short."""
    segments = F.to_json(
        F.transform(
            F.split("text", "\n"),
            lambda s, i: F.struct(
                (i * 5).cast("double").alias("from_sec"), (i * 5 + 4).cast("double").alias("to_sec"), s.alias("text")
            ),
        )
    )
    broken = F.expr("left(segments, length(segments) - 1)")
    rows = load(spark, folder, "documents").select(
        F.col("doc_id").alias("caption_id"), F.floor(F.col("doc_id") / 2).alias("video_id"), segments.alias("segments")
    ).withColumn("segments", F.when(F.col("caption_id") % 13 == 0, broken).otherwise(F.col("segments")))
    videos = load(spark, folder, "documents").where("doc_id % 2 = 0").select(
        F.floor(F.col("doc_id") / 2).alias("id"),
        F.concat(F.lit("v"), F.floor(F.col("doc_id") / 2).cast("string")).alias("external_id"),
    )
    return rows, videos


@query("s1_load_captions", _DOC_SEGMENTS)
def s1(spark, folder):
    return readers.load_captions(*_caption_rows(spark, folder))[0]


@query(
    "s1_caption_quarantine",
    "SELECT doc_id AS caption_id, 'v' || doc_id // 2 AS external_id FROM documents WHERE doc_id % 26 = 0",
)
def s1_bad(spark, folder):
    return readers.load_captions(*_caption_rows(spark, folder))[1].select("caption_id", "external_id")


@query(
    "j1_captions_of_videos",
    """SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def j1(spark, folder):
    d = load(spark, folder, "documents").select("doc_id", "lang")
    return d.join(load(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


def _book_text(spark, folder):
    d = load(spark, folder, "documents")
    part = F.transform(
        F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")),
        lambda i: F.struct(
            F.col("source").alias("video_id"), (i * 60).cast("double").alias("from_sec"), (i * 60 + 60).cast("double").alias("to_sec"),
            F.concat(F.lit("segment "), i.cast("string")).alias("title"), F.col("lang").alias("text"),
            (F.col("doc_id") % 100).cast("double").alias("relevance_pct"), (i % 2 == 0).alias("has_visual_structure"),
        ),
    )
    doc = F.struct(
        F.col("doc_id").cast("string").alias("collection_id"), F.concat(F.lit("goal "), "lang").alias("center_goal"), part.alias("segments")
    )
    raw = F.to_json(doc)
    return d.select("doc_id", F.when(F.col("doc_id") % 10 == 9, F.concat(raw, F.lit("}"))).otherwise(raw).alias("raw"))


@query(
    "s3_book_index",
    """SELECT CAST(doc_id AS VARCHAR) AS collection_id, 'goal ' || lang AS center_goal, CAST(i AS INTEGER) AS pos, source AS video_id,
         CAST(i * 60 AS DOUBLE) AS from_sec, CAST(i * 60 + 60 AS DOUBLE) AS to_sec, 'segment ' || i AS title, lang AS text,
         CAST(doc_id % 100 AS DOUBLE) AS relevance_pct, i % 2 = 0 AS has_visual_structure
       FROM documents, unnest(range(0, doc_id % 4 + 1)) AS g(i) WHERE doc_id % 10 <> 9""",
)
def s3(spark, folder):
    return readers.parse_book_index(_book_text(spark, folder))[0]


@query("s4_sample_set", "SELECT CAST(event_id AS VARCHAR) AS index, CAST(user_id AS VARCHAR) AS video_id FROM events")
def s4(spark, folder):
    entries = events(spark, folder).select(
        F.col("event_id").cast("string").alias("index"), F.col("user_id").cast("string").alias("video_id")
    )
    return readers.sample_set(entries)


def _manifest_text(spark, folder):
    figure = lambda i: F.struct(
        F.concat(F.lit("f"), i.cast("string")).alias("figure_id"), F.lit("redrawn").alias("kind"), F.lit("verified").alias("verification_status")
    )
    n = (F.col("doc_id") % 3 + 1).cast("int")
    doc = F.struct(
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("manifest_id"),
        F.when(F.col("doc_id") % 5 == 0, "0.9").otherwise("1.0").alias("schema_version"),
        F.struct(n.alias("total")).alias("summary"),
        F.transform(F.sequence(F.lit(1), n), figure).alias("figures"),
    )
    raw = F.to_json(doc)
    return load(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, F.expr("'[1, 2'")).otherwise(raw).alias("raw")
    )


@query(
    "s5_manifests",
    """SELECT 'm' || doc_id AS manifest_id, '1.0' AS schema_version, doc_id % 3 + 1 AS total, CAST(doc_id % 3 + 1 AS INTEGER) AS n_figures
       FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0""",
)
def s5(spark, folder):
    return readers.parse_manifests(_manifest_text(spark, folder))[0].select(
        "manifest_id", "schema_version", "summary.total", F.size("figures").alias("n_figures")
    )


@query(
    "s5_manifest_quarantine",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'manifest_parse' ELSE 'manifest_version_check' END AS stage
       FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""",
)
def s5_bad(spark, folder):
    return readers.parse_manifests(_manifest_text(spark, folder))[1].select("doc_id", "stage")


@query(
    "s6_outlines",
    """SELECT lpad(CAST(doc_id AS VARCHAR), 11, '0') AS video_id, CAST(i AS INTEGER) AS position, CASE WHEN i = 0 THEN 'cover' ELSE 'key_points' END AS layout
       FROM documents, unnest(range(0, doc_id % 3 + 1)) AS g(i) WHERE doc_id % 4 <> 0""",
)
def s6(spark, folder):
    d = F.col("doc_id")
    slide = lambda i: F.struct(
        i.alias("position"), F.when(i == 0, "cover").otherwise("key_points").alias("layout")
    )
    doc = F.struct(
        F.when(d % 4 == 0, F.format_string("%010d", d)).otherwise(F.format_string("%011d", d)).alias("video_id"),
        F.transform(F.sequence(F.lit(0), (d % 3).cast("int")), slide).alias("slides"),
    )
    texts = load(spark, folder, "documents").select("doc_id", F.to_json(doc).alias("raw"))
    good, _ = readers.parse_outlines(texts)
    return good.select("video_id", F.explode("slides").alias("s")).select("video_id", "s.position", "s.layout")


@query(
    "s7_ingest_boxes",
    """WITH b AS (SELECT o_orderkey AS frame_id, i AS box_index, round(((o_orderkey * 7 + i * 13) % 100) / 100, 6) AS score, 'table' AS cls,
         CAST(i AS DOUBLE) AS x FROM orders, unnest(range(0, 4)) AS g(i))
       SELECT frame_id, CAST(box_index AS INTEGER) AS box_index, score, cls, x FROM b WHERE score >= 0.15
       QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, box_index) <= 2""",
)
def s7(spark, folder):
    box = lambda i: F.struct(
        F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("w"), F.lit(5.0).alias("h")).alias("bbox"),
        F.lit("table").alias("cls"),
        (((F.col("o_orderkey") * 7 + i * 13) % 100) / 100).alias("score"),
    )
    doc = F.struct(
        F.struct(F.lit(100).alias("w"), F.lit(50).alias("h")).alias("image"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), box).alias("boxes"),
    )
    replies = load(spark, folder, "orders").select(F.col("o_orderkey").alias("frame_id"), F.to_json(doc).alias("raw"))
    return readers.ingest_boxes(replies, 2)[0].select("frame_id", "box_index", F.round("score", 6).alias("score"), "cls", "x")
