"""Job log as a stream: the state of every job kept current (T1), timeouts by timer (T2)."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cuesheet.operators.gates import JOB_STAGES
from cuesheet.operators.jobs import timeout_sweep
from cuesheet.sources.store import Change, Store, hash_bucket

LOG_COLUMNS = ("seq", "event_us", "event", "stage", "timeout_us", "attempt_count", "last_error")
# The rows kept of a job as one JSON text, and its timer.
KEPT_SCHEMA = "rows string, timer bigint"
# The jobs of a group as one JSON text, its timer, and the number of groups that the text is made for.
GROUP_SCHEMA = "jobs string, timer bigint, groups int"
GROUPS = 4_096
_GROUP = "_group"
# Each cell of a row costs a conversion, so a log row travels to its group as one JSON text.
_ENTRY = "_entry"
_NUMBERS = ("seq", "event_us", "timeout_us", "attempt_count")
# Rows of one job that are collected before they are cut to those that count.
_PENDING = 64
STATE_SCHEMA = (
    "job_id string, stage string, status string, timeout_us bigint, attempt_count bigint, last_error string, "
    "failure_stage string, event_us bigint, seq bigint, timed_out boolean"
)
# Columns of the state that have a last writer of their own.
COLUMNS = ("stage", "status", "timeout_us", "attempt_count", "last_error", "failure_stage")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobStates(StatefulProcessor):
    """State of one job: the log rows that last wrote a column of it, at most seven.

    Which rows those are does not depend on the order in which events come, or on repeats. A timer
    at the deadline turns a running job into an error when the stream's event time passes it, with no
    event of the job; a timer at the end of ``keep`` drops a finished job.

    All is one value with the timer beside it: each call to the state is a message between processes, and
    listing lists or timers opens an iterator that the store holds until the task ends.
    """

    def __init__(self, first_stage: str, keep_ms: int):
        self.first_stage, self.keep_ms = first_stage, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT_SCHEMA)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, timer = self._known()
        winners = self._winners(known + [tuple(r[c] for c in LOG_COLUMNS) for r in rows])
        state = self._state(winners, timerValues.getCurrentWatermarkInMs())
        wanted = self._timer(state)
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        kept = list(dict.fromkeys(winners.values()))
        if (kept, wanted) != (known, timer):
            self.kept.update((json.dumps(kept), wanted))
        yield Row(job_id=key[0], **state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, timer = self._known()
        if not known:
            return
        winners = self._winners(known)
        state = self._state(winners, timerValues.getCurrentWatermarkInMs())
        # The engine deletes the timer that has expired.
        if state["timed_out"] and expiredTimerInfo.getExpiryTimeInMs() == self._deadline(winners):
            wanted = self._timer(state)
            self.handle.registerTimer(wanted)
            self.kept.update((json.dumps(known), wanted))
            yield Row(job_id=key[0], **state)
        elif state["status"] in ("done", "error"):
            self.kept.clear()

    def _known(self) -> tuple[list[tuple], int | None]:
        """Rows kept of the job and its timer; none of a new job."""
        kept = self.kept.get()
        return ([tuple(r) for r in json.loads(kept[0])], kept[1]) if kept is not None else ([], None)

    @staticmethod
    def _mark(row: tuple) -> tuple:
        seq, us = row[0], row[1]
        return (us is not None, us or 0, seq is not None, seq or 0)

    def _winners(self, rows: list[tuple]) -> dict[str, tuple]:
        """Newest row that writes each column; ``last`` is the newest of all."""
        out: dict[str, tuple] = {}
        # Rows of one mark are told apart by their content, so any order of them gives one result.
        for row in sorted(rows, key=lambda r: (self._mark(r), [(v is not None, str(v)) for v in r])):
            event = row[2]
            out["status"] = out["timeout_us"] = out["last"] = row
            if event in ("create", "enter"):
                out["stage"] = row
            if row[5] is not None:
                out["attempt_count"] = row
            if event in ("complete", "fail"):
                out["last_error"] = row
            if event == "fail":
                out["failure_stage"] = row
        return out

    def _state(self, winners: dict[str, tuple], watermark_ms: int) -> dict:
        get = {c: winners.get(c) for c in COLUMNS}
        stage = get["stage"] and (self.first_stage if get["stage"][2] == "create" else get["stage"][3])
        status = {"create": "queued", "enter": "running", "complete": "done"}.get(get["status"][2], "error")
        timeout = get["timeout_us"][4] if get["timeout_us"][2] == "enter" else None
        error = get["last_error"] and (get["last_error"][6] if get["last_error"][2] == "fail" else None)
        late = status == "running" and timeout is not None and watermark_ms >= timeout // 1000 + 1
        return {
            "stage": stage,
            "status": "error" if late else status,
            "timeout_us": None if late else timeout,
            "attempt_count": get["attempt_count"] and get["attempt_count"][5],
            "last_error": "timeout" if late else error,
            "failure_stage": stage if late else get["failure_stage"] and get["failure_stage"][3],
            "event_us": winners["last"][1],
            "seq": winners["last"][0],
            "timed_out": late,
        }

    def _deadline(self, winners: dict[str, tuple]) -> int | None:
        """First whole millisecond past the time a running job may take."""
        row = winners["timeout_us"]
        return row[4] // 1000 + 1 if row[2] == "enter" and row[4] is not None else None

    def _timer(self, state: dict) -> int | None:
        if state["status"] in ("done", "error"):
            return (state["event_us"] or 0) // 1000 + self.keep_ms
        if state["status"] == "running" and state["timeout_us"] is not None:
            return state["timeout_us"] // 1000 + 1
        return None


class JobGroups(JobStates):
    """States of the jobs of one hash group, kept as one value with one timer, that of the job due first.

    A key costs some messages between processes and a batch of rows of its own, whatever it holds; a group
    pays them once for all its jobs. A batch rewrites the jobs of every group it touches.
    """

    def __init__(self, first_stage: str, keep_ms: int, groups: int):
        super().__init__(first_stage, keep_ms)
        self.groups = groups

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("jobs", GROUP_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, timer = self._known()
        # A job may hold most rows of a batch, so its rows are cut as they come.
        fresh: dict[str | None, list[tuple]] = {}
        for row in rows:
            job, seq, us, event, stage, timeout, attempts, error = json.loads(row[_ENTRY])
            pending = fresh.setdefault(job, [])
            pending.append((_number(seq), _number(us), event, stage, _number(timeout), _number(attempts), error))
            if len(pending) >= _PENDING:
                pending[:] = self._cut(self._winners(pending))
        watermark = timerValues.getCurrentWatermarkInMs()
        changed = False
        for job, entries in fresh.items():
            before = known.get(job)
            winners = self._winners([tuple(r) for r in before[0]] + entries if before else entries)
            state = self._state(winners, watermark)
            after = [[list(r) for r in self._cut(winners)], self._timer(state)]
            if after != before:
                known[job], changed = after, True
            yield Row(job_id=job, **state)
        if changed:
            self._keep(known, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, _ = self._known()
        watermark = timerValues.getCurrentWatermarkInMs()
        for job, (rows, timer) in list(known.items()):
            if timer is None or timer > watermark:
                continue
            winners = self._winners([tuple(r) for r in rows])
            state = self._state(winners, watermark)
            if state["timed_out"] and timer == self._deadline(winners):
                # A time to leave that is the deadline itself would look like one not passed yet.
                known[job][1] = self._timer(state) + (self._timer(state) == timer)
                yield Row(job_id=job, **state)
            else:
                del known[job]
        self._keep(known, None, expiredTimerInfo.getExpiryTimeInMs())

    def _known(self) -> tuple[dict[str | None, list], int | None]:
        """Rows kept of every job of the group with its timer, and the timer of the group."""
        kept = self.kept.get()
        if kept is None:
            return {}, None
        if kept[2] != self.groups:
            raise ValueError(f"the checkpoint was begun with {kept[2]} groups, not {self.groups}")
        return {job: [rows, timer] for job, rows, timer in json.loads(kept[0])}, kept[1]

    def _keep(self, known: dict[str | None, list], timer: int | None, expired: int | None = None) -> None:
        wanted = min((t for _, t in known.values() if t is not None), default=None)
        if wanted is not None and wanted == expired:
            # The engine deletes the timer that has expired, after this call.
            wanted += 1
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if known:
            self.kept.update((json.dumps([[job, *held] for job, held in known.items()]), wanted, self.groups))
        else:
            self.kept.clear()

    @staticmethod
    def _cut(winners: dict[str, tuple]) -> list[tuple]:
        return list(dict.fromkeys(winners.values()))


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _entry() -> Column:
    """Log row as a JSON list of texts, its job first."""
    cells = [F.col(c).cast("bigint") if c in _NUMBERS else F.col(c) for c in ("job_id", *LOG_COLUMNS)]
    return F.to_json(F.array(*[c.cast("string") for c in cells]))


def job_states(log: DataFrame, late: str = "7 days", keep_days: float = 7, groups: int | None = GROUPS) -> DataFrame:
    """Changed states of the jobs of a streamed ``log``, ``timed_out`` among them.

    Event time ends ``late`` behind the newest event; rows older than that are dropped by the engine, and
    a running job whose deadline it passes becomes an error then, as ``timeout_sweep`` does at that
    time. Finished jobs leave the state ``keep_days`` after their last event (a later event of theirs
    would start them anew, so keep them at least as long as events may be late).

    Jobs are kept in ``groups`` by the hash of their id; the number is fixed for a checkpoint. None keeps every
    job under a key of its own, for small batches over so many kept jobs that groups are large.
    """
    # The processor travels inside the plan, so executors need no installed package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    timed = log.withColumn("event_time", F.timestamp_micros("event_us")).withWatermark("event_time", late)
    keep_ms = int(keep_days * 86_400_000)
    if groups is None:
        key, processor = "job_id", JobStates(JOB_STAGES[0], keep_ms)
    else:
        key, processor = _GROUP, JobGroups(JOB_STAGES[0], keep_ms, groups)
        timed = timed.select(hash_bucket(["job_id"], groups).alias(_GROUP), "event_time", _entry().alias(_ENTRY))
    return timed.groupBy(key).transformWithState(processor, STATE_SCHEMA, "Update", "EventTime")


def start_job_state(
    log: DataFrame,
    store: Store,
    checkpoint: str,
    available_now: bool = False,
    late: str = "7 days",
    keep_days: float = 7,
    compact_at: int = 8,
    groups: int | None = GROUPS,
) -> StreamingQuery:
    """Keep the table ``jobs`` of ``store`` current with the state of every job in ``log``.

    Each micro-batch adds the jobs it changed under its own number, so a batch that is replayed
    changes nothing. Buckets of more than ``compact_at`` folders are merged to the newest row of each
    job, and folders nobody names are deleted, so neither grows with the number of batches.
    """
    spark = log.sparkSession

    def write(changed: DataFrame, batch: int) -> None:
        store.commit([Change("jobs", changed.withColumn("batch", F.lit(batch).cast("bigint")), ["job_id"])], (checkpoint, batch))
        if store.compact("jobs", newest, compact_at):
            store.vacuum()

    # Timers need the store of states that keeps them; the setting is read when a query starts.
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    writer = job_states(log, late, keep_days, groups).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def newest(table: DataFrame) -> DataFrame:
    """Row of the newest batch of every job."""
    columns = [c for c in table.columns if c != "job_id"]
    last = F.max_by(F.struct(*columns), "batch")
    return table.groupBy("job_id").agg(last.alias("_s")).select("job_id", "_s.*").select(*table.columns)


def read_job_state(store: Store) -> DataFrame:
    """Newest state of every job."""
    return newest(store.read("jobs")).drop("batch")


def sweep_job_state(store: Store, as_of_us: Column) -> DataFrame:
    """Stored states with jobs overdue at a later time turned into errors."""
    return timeout_sweep(read_job_state(store).drop("timed_out"), as_of_us)
