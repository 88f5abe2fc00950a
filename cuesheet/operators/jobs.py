"""Job logs and run reports: current state, gates, failure families (A and K families)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.gates import JOB_STAGES, timed_out
from cuesheet.ordering import position

RECOGNITION_STAGES = ("detect", "select", "numerize")
BUILD_STAGES = ("build", "validate")
FAMILIES = ("recognition", "build", "other", "none")


def job_state(log: DataFrame) -> DataFrame:
    """Current state of every job from its append-only log.

    ``log(job_id, seq, event_us, event, stage, timeout_us, attempt_count, last_error)`` with the
    events create, enter, complete and fail. Each column has its own last writer, so each is a
    ``max_by`` over the events that write it: no window, map-side combined, and unharmed by
    repeated events. The same plan runs on a stream.
    """
    event = F.col("event")
    when = F.struct("event_us", "seq")

    def last(value: Column, *events: str) -> Column:
        return F.max_by(value, F.when(event.isin(*events), when) if events else when)

    return log.groupBy("job_id").agg(
        last(
            F.when(event == "create", F.lit(JOB_STAGES[0])).otherwise(F.col("stage")), "create", "enter"
        ).alias("stage"),
        last(
            F.when(event == "create", "queued")
            .when(event == "enter", "running")
            .when(event == "complete", "done")
            .otherwise("error")
        ).alias("status"),
        last(F.when(event == "enter", F.col("timeout_us"))).alias("timeout_us"),
        F.max_by("attempt_count", F.when(F.col("attempt_count").isNotNull(), when)).alias("attempt_count"),
        last(F.when(event == "fail", F.col("last_error")), "complete", "fail").alias("last_error"),
        last(F.col("stage"), "fail").alias("failure_stage"),
        F.max(when).alias("_last"),
    ).withColumns({"event_us": F.col("_last.event_us"), "seq": F.col("_last.seq")}).drop("_last")


def log_rows(changes: DataFrame, event: str) -> DataFrame:
    """Log rows for one kind of change; columns the change does not carry are null."""
    wanted = {
        "job_id": "string", "seq": "bigint", "event_us": "bigint", "stage": "string",
        "timeout_us": "bigint", "attempt_count": "bigint", "last_error": "string",
    }
    have = set(changes.columns)
    columns = [
        (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()
    ]
    return changes.select(*columns, F.lit(event).alias("event"))


def timeout_sweep(state: DataFrame, as_of_us: Column) -> DataFrame:
    """Running jobs past their deadline become errors pinned to the stage they were in."""
    late = timed_out(F.col("status"), F.col("timeout_us"), as_of_us)
    return state.withColumn("_late", late).withColumns(
        {
            "status": F.when(F.col("_late"), "error").otherwise(F.col("status")),
            "last_error": F.when(F.col("_late"), "timeout").otherwise(F.col("last_error")),
            "failure_stage": F.when(F.col("_late"), F.col("stage")).otherwise(F.col("failure_stage")),
            "timeout_us": F.when(~F.col("_late"), F.col("timeout_us")),
            "timed_out": F.col("_late"),
        }
    ).drop("_late")


def deck_status(changes: DataFrame) -> DataFrame:
    """Latest status and error of every deck from its change log."""
    last = F.max_by(F.struct("status", "error"), F.struct("event_us", "seq"))
    return changes.groupBy("deck_id").agg(last.alias("_l")).select("deck_id", "_l.*")


# --- run reports ----------------------------------------------------------------------------

PASS_RATIO = 0.9
MAX_MEAN_ATTEMPTS = 2.0
REPORT_CONFIDENCE = 0.7


def family(stage: Column) -> Column:
    return (
        F.when(stage.isNull(), "none")
        .when(stage.isin(*RECOGNITION_STAGES), "recognition")
        .when(stage.isin(*BUILD_STAGES), "build")
        .otherwise("other")
    )


def failure_families(runs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Runs per failure family, all four families present.

    A run with an error but no stage counts as ``none``; how many those are is told beside it.
    """
    counts = {f: F.count_if(family(F.col("failure_stage")) == f) for f in FAMILIES}
    lost = F.count_if(F.col("failure_stage").isNull() & F.col("error").isNotNull())
    wide = runs.groupBy(*group).agg(*[c.alias(f) for f, c in counts.items()], lost.alias("_lost"))
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("family"),
                F.col(f).alias("n_runs"),
                (F.col("_lost") if f == "none" else F.lit(0).cast("bigint")).alias("unattributed"),
            )
            for f in FAMILIES
        ]
    )
    return wide.select(*group, F.explode(rows).alias("_r")).select(*group, "_r.*")


def run_gates(runs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pass ratio, mean attempts and low-confidence share with their verdicts.

    ``runs`` needs ``validate_pass, attempts, failure_stage, error, conf_below, conf_total``. Attempts of
    calls that crashed, ``crashed_attempts`` where known, count as well: they were made.
    """
    completed = F.col("failure_stage").isNull() & F.col("error").isNull()
    made = F.col("attempts")
    if "crashed_attempts" in runs.columns:
        made = made + F.coalesce("crashed_attempts", F.lit(0))
    mean = F.avg(F.when(completed, made))
    return (
        runs.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.count_if("validate_pass").alias("n_pass"),
            F.count_if(completed).alias("n_completed"),
            F.coalesce(mean, F.lit(0.0)).alias("mean_attempts"),
            F.sum("conf_below").alias("conf_below"),
            F.sum("conf_total").alias("conf_total"),
        )
        .withColumns(
            {
                "pass_ratio": F.try_divide("n_pass", "n_runs"),
                "conf_share": F.try_divide("conf_below", "conf_total"),
            }
        )
        .withColumns(
            {
                "g1_pass": (F.col("n_runs") > 0) & (F.col("pass_ratio") >= PASS_RATIO),
                "g2_pass": (F.col("n_completed") > 0) & (F.col("mean_attempts") <= MAX_MEAN_ATTEMPTS),
            }
        )
    )


def empty_gates_row(gates: DataFrame) -> DataFrame:
    """For an ungrouped report: both gates fail on an empty input instead of being null."""
    return gates.fillna({"g1_pass": False, "g2_pass": False})


def confidence_counts(figures: DataFrame, group: Sequence[str]) -> DataFrame:
    """Figures below the reporting threshold, and figures that carry a confidence at all."""
    return figures.groupBy(*group).agg(
        F.count_if(F.col("confidence") < REPORT_CONFIDENCE).alias("conf_below"),
        F.count("confidence").alias("conf_total"),
    )


def stage_counts(frames: DataFrame, figures: DataFrame) -> DataFrame:
    """Candidates, selected frames, boxes, charts and formulas per recording.

    An empty struct or an empty formula does not count.
    """
    chosen = frames.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("is_slide").alias("selected")
    )
    found = figures.groupBy("video_id").agg(
        F.count_if(F.col("has_box")).alias("boxed"),
        F.count_if(~F.col("struct").isin("", "{}", "[]", "null")).alias("charts"),
        F.count_if(F.col("latex") != "").alias("formulas"),
    )
    return chosen.join(found, "video_id", "left").fillna(0, ["boxed", "charts", "formulas"])


def exact_quantile(
    df: DataFrame, group: Sequence[str], value: str, q: float, slot: Column, out: str
) -> DataFrame:
    """Interpolated quantile of a group without sorting the group in one task.

    ``slot`` must not decrease with ``value``. ``F.approx_percentile`` is the cheaper choice
    where an error is acceptable.
    """
    known = df.where(F.col(value).isNotNull()).select(*group, value)
    ranked = position(known, group, [F.col(value)], slot, "_pos", "_n")
    at = F.lit(q) * (F.col("_n") - 1)
    lo, hi = F.floor(at), F.ceil(at)
    near = ranked.where((F.col("_pos") == lo) | (F.col("_pos") == hi)).withColumn("_share", at - lo)
    return near.groupBy(*group).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.max("_share").alias("_share")
    ).select(*group, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")).alias(out))


# Size of a stored quantile sketch, and the error of a rank it is stated for, merged or not.
SKETCH_SIZE, RANK_ERROR = 400, 0.01


def quantile_sketches(df: DataFrame, group: Sequence[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """``sketch`` of the values of each group: a few kilobytes, combined map-side.

    Kept by stage and day, say, they answer for any range of days without the values.
    """
    return df.groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def sketched_quantile(sketches: DataFrame, group: Sequence[str], q: float, out: str) -> DataFrame:
    """Quantile of each ``group`` over merged sketches, with the number of values, ``n_values``.

    The rank of the result is off by at most ``RANK_ERROR`` with a probability of 99 %. A group without
    values has a null quantile.
    """
    merged = sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch").alias("_merged"))
    count = F.kll_sketch_get_n_double("_merged")
    known = F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("_merged", F.lit(q)))
    return merged.withColumn("n_values", count).select(*group, known.alias(out), "n_values")
