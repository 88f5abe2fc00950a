"""Sequence operators over captions and frames (W family) and the set steps they need (U)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.timeline import cosine_distance, hamming
from cuesheet.ordering import TIME_SLOT_SEC, ord_slot, position, previous, time_slot
from cuesheet.session import stored

MIN_SEGMENT_SEC = 5.0
TOPIC_DISTANCE = 0.30
LABEL_CHARS = 60
NEAR_DUP_BITS = 10
FRAME_TARGET = 60
SLIDE_CAP = 20
# Recordings up to this size are folded as one array.
FOLD_ROWS = 512
# Frames of a longer recording walked by one task, and hashes told of a piece to the others.
PIECE_ROWS = 250_000
SUMMARY_ROWS = 1_024
# Frames of neighbouring small pieces that one call in a task works off, piece by piece.
CALL_ROWS = 25_000


def long_segments(captions: DataFrame, min_sec: float = MIN_SEGMENT_SEC) -> DataFrame:
    """Drop segments too short to carry a topic. Runs before adjacency is looked at."""
    return captions.where(F.col("to_sec") - F.col("from_sec") >= min_sec)


def topic_boundaries(
    captions: DataFrame,
    threshold: float = TOPIC_DISTANCE,
    min_sec: float = MIN_SEGMENT_SEC,
    slot: Column | None = None,
    label_chars: int = LABEL_CHARS,
) -> DataFrame:
    """Segments that open a new topic: far from the previous kept segment of the recording.

    The label is the first ``label_chars`` characters of the text. Needs ``video_id, ord, from_sec, to_sec, text, embedding``.
    """
    kept = long_segments(captions, min_sec)
    paired = previous(
        kept, ["video_id"], ["ord"], ord_slot("ord") if slot is None else slot,
        {"_prev": "embedding"},
    )
    return (
        paired.withColumn("distance", cosine_distance(F.col("_prev"), F.col("embedding")))
        .where(F.col("distance") > threshold)
        .select(
            "video_id",
            "ord",
            F.col("from_sec").alias("timestamp_sec"),
            F.when(F.col("text") != "", F.substring("text", 1, label_chars)).alias("topic_label"),
            "distance",
        )
    )


def near_duplicate_runs(
    frames: DataFrame,
    radius: int = NEAR_DUP_BITS,
    slot_sec: float = TIME_SLOT_SEC,
    fold_rows: int = FOLD_ROWS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add ``run_no``, the number of a frame's run in its recording, and ``n_runs``.

    A frame joins the run while its hash is within ``radius`` bits of the run's *first* frame,
    so the walk cannot be written with ``lag``. Each recording of at most ``fold_rows`` frames is
    folded as one array; each longer one is walked in pieces, see ``_walk_pieces``.
    """
    known = frames.where(F.col("phash").isNotNull())
    long = stored(known.groupBy(F.col("video_id").alias("_long")).count().where(F.col("count") > fold_rows).select("_long"))
    columns = [*known.columns, "run_no", "n_runs"]
    if long.isEmpty():
        return _fold_recordings(known, radius).select(columns)
    is_long = F.col("video_id").eqNullSafe(F.col("_long"))
    short = _fold_recordings(known.join(long, is_long, "left_anti"), radius)
    walked = _walk_pieces(known.join(long, is_long, "left_semi"), radius, slot_sec, piece_rows)
    return short.select(columns).unionByName(walked.select(columns))


def _fold_recordings(known: DataFrame, radius: int) -> DataFrame:
    others = [c for c in known.columns if c not in ("video_id", "phash", "timestamp_sec", "ord")]
    row = F.struct("timestamp_sec", "ord", F.col("phash").alias("hash"), *others)
    folded = (
        known.groupBy("video_id")
        .agg(F.array_sort(F.collect_list(row)).alias("_items"))
        .withColumn("_runs", _fold_runs(F.col("_items"), radius))
    )
    # The rows travel inside the folded array, so no join back is needed.
    return folded.select(
        "video_id",
        F.explode(F.arrays_zip(F.col("_items").alias("row"), F.col("_runs").alias("run"))).alias("_z"),
        (F.element_at("_runs", -1) + 1).alias("n_runs"),
    ).select(
        "video_id",
        F.col("_z.row.hash").alias("phash"),
        *[F.col(f"_z.row.{c}").alias(c) for c in ("timestamp_sec", "ord", *others)],
        F.col("_z.run").alias("run_no"),
        "n_runs",
    )


def _fold_runs(items: Column, radius: int) -> Column:
    """Run number of every item, in order."""
    start = F.struct(
        F.lit(None).cast("bigint").alias("first"),
        F.lit(-1).cast("bigint").alias("no"),
        F.array().cast("array<bigint>").alias("numbers"),
    )

    def step(acc: Column, item: Column) -> Column:
        starts = acc["first"].isNull() | (hamming(acc["first"], item["hash"]) > radius)
        number = F.when(starts, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(
            F.when(starts, item["hash"]).otherwise(acc["first"]).alias("first"),
            number.alias("no"),
            F.concat(acc["numbers"], F.array(number)).alias("numbers"),
        )

    return F.aggregate(items, start, step, lambda acc: acc["numbers"])


def walk_runs(hashes: np.ndarray, entered: int | None, radius: int) -> tuple[np.ndarray, int]:
    """Run number of each hash in order, and the first hash of the run left open.

    Numbers start at 0; -1 marks hashes that still belong to the entered run.
    """
    bits = hashes.astype(np.int64).view(np.uint64)
    numbers = np.empty(len(bits), dtype=np.int64)
    first = None if entered is None else np.int64(entered).view(np.uint64)
    at, number = 0, -1
    while at < len(bits):
        if first is None or np.bitwise_count(bits[at] ^ first) > radius:
            first, number = bits[at], number + 1
        # Look for the end of the run in blocks of growing size.
        end, block = at + 1, 16
        while end < len(bits):
            far = np.flatnonzero(np.bitwise_count(bits[end : end + block] ^ first) > radius)
            if far.size:
                end += int(far[0])
                break
            end, block = min(len(bits), end + block), block * 2
        numbers[at:end] = number
        at = end
    return numbers, int(first.view(np.int64))


def summarise_piece(hashes: np.ndarray, entered: int | None, radius: int) -> dict:
    """What a piece does to a run that enters it, as far as ``SUMMARY_ROWS`` hashes tell.

    ``exit`` and ``begun`` hold for the guess ``entered``. ``head`` are the first hashes and ``starts`` the
    places in it where a run of that walk begins: another walk that begins a run at one of them goes
    on as this one. ``kinds`` are the different hashes of the whole piece, if they are few enough: a run
    near all of them passes through.
    """
    numbers, left = walk_runs(hashes, entered, radius)
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    kinds = np.unique(hashes)
    return {
        "size": len(hashes),
        "exit": left,
        "begun": int(numbers[-1]) + 1,
        "head": hashes[:SUMMARY_ROWS].tolist(),
        "starts": starts[starts < SUMMARY_ROWS].tolist(),
        "kinds": kinds.tolist() if len(kinds) <= SUMMARY_ROWS else None,
    }


def enter_piece(summary: dict, entered: int, radius: int) -> tuple[int, int] | None:
    """Run left open and runs begun when the run of ``entered`` comes into a piece, or None if its
    summary does not tell."""
    first = np.int64(entered).view(np.uint64)
    kinds = summary["kinds"]
    if kinds is not None and not (np.bitwise_count(np.asarray(kinds, np.int64).view(np.uint64) ^ first) > radius).any():
        return entered, 0
    head, begun, at = np.asarray(summary["head"], np.int64).view(np.uint64), 0, 0
    common = set(summary["starts"])
    while True:
        far = np.flatnonzero(np.bitwise_count(head[at:] ^ first) > radius)
        if not far.size:
            # The run stays open to the end of what is known.
            return (int(first.view(np.int64)), begun) if len(head) == summary["size"] else None
        at += int(far[0])
        if at in common:
            return summary["exit"], begun + summary["begun"] - sum(s < at for s in summary["starts"])
        first, begun = head[at], begun + 1


def _walk_pieces(known: DataFrame, radius: int, slot_sec: float, piece_rows: int) -> DataFrame:
    """Runs of recordings of any length, walked in pieces of ``piece_rows`` frames.

    The walk of a piece depends only on the run left open before it. Each piece is walked once from a
    guess and leaves a summary of bounded size: what it does to any entering run, up to the first run
    start that the two walks have in common. Summaries are composed along their recording, which gives the
    run that enters each piece. A piece whose summary does not tell stops its recording; those pieces
    are summarised again, now from the run known or guessed to enter them, until none is left. At
    least one piece more is known each time, mostly all. Last, frames are numbered in one pass.
    Small pieces share a call, so the calls grow with the frames and not with the pieces.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keys = ["video_id", "_piece"]
    along = Window.partitionBy("video_id").orderBy("_piece")
    order = [F.col("timestamp_sec"), F.col("ord")]
    placed = position(known, ["video_id"], order, time_slot("timestamp_sec", slot_sec), "_pos")
    pieces = stored(placed.withColumn("_piece", F.floor(F.col("_pos") / piece_rows)))
    hashes = pieces.select(*keys, "_pos", "phash")
    call = ["video_id", F.floor(F.col("_piece") / max(1, CALL_ROWS // piece_rows)).alias("_call")]
    video = known.schema["video_id"].dataType.simpleString()

    # Runs travel as text: a nullable 64-bit integer would become a float in pandas.
    def pieces_of(rows: pd.DataFrame) -> Iterator[tuple[int, str | None, np.ndarray]]:
        """Number, entered run and hashes of each piece of rows in order."""
        numbers, entries, hashes = rows["_piece"].to_numpy(), rows["_entry"].to_numpy(), rows["phash"].to_numpy()
        starts = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist()
        for start, end in zip(starts, [*starts[1:], len(numbers)]):
            entry = entries[start]
            yield int(numbers[start]), None if pd.isna(entry) else entry, hashes[start:end]

    def summarised(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for piece, entry, own in pieces_of(rows.sort_values("_pos")):
            found = summarise_piece(own, None if entry is None else int(entry), radius)
            found["exit"] = str(found["exit"])
            out.append({"video_id": key[0], "_piece": piece, "guess": entry, **found})
        return pd.DataFrame(out)

    summary = f"video_id {video}, _piece bigint, guess string, size bigint, exit string, begun bigint, head array<bigint>, starts array<int>, kinds array<bigint>"

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        """Run that enters each piece, whether that is known, and the runs begun before."""
        rows = rows.sort_values("_piece")
        out, entry, offset, sure = [], None, 0, True
        for r in rows.to_dict("records"):
            guess = None if pd.isna(r["guess"]) else int(r["guess"])
            step = (int(r["exit"]), int(r["begun"]))
            told = sure
            if sure and entry != guess:
                exact = enter_piece({**r, "exit": step[0]}, entry, radius)
                told, step = exact is not None, exact or step
            out.append((r["video_id"], r["_piece"], None if entry is None else str(entry), told, offset))
            # Behind a piece that does not tell, what follows is a guess.
            sure, entry, offset = told, step[0], offset + step[1]
        return pd.DataFrame(out, columns=["video_id", "_piece", "_entry", "_sure", "_offset"]).assign(n_runs=offset)

    entries = f"video_id {video}, _piece bigint, _entry string, _sure boolean, _offset bigint, n_runs bigint"
    state = stored(hashes.withColumn("_entry", F.lit(None).cast("string")).groupBy(*call).applyInPandas(summarised, summary))
    while True:
        entered = stored(state.groupBy("video_id").applyInPandas(composed, entries))
        unsure = entered.where("not _sure").select(*keys, "_entry")
        if unsure.isEmpty():
            break
        again = _of_pieces(hashes, unsure).groupBy(*call).applyInPandas(summarised, summary)
        same = F.col("s.video_id").eqNullSafe(F.col("u.video_id")) & (F.col("s._piece") == F.col("u._piece"))
        state = stored(state.alias("s").join(unsure.alias("u"), same, "left_anti").unionByName(again))

    def numbered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        walks = [walk_runs(own, None if entry is None else int(entry), radius)[0] for _, entry, own in pieces_of(rows)]
        return rows.assign(_no=np.concatenate(walks))[columns]

    full = _of_pieces(pieces, entered.drop("_sure"))
    columns = [*known.columns, "_offset", "n_runs", "_no"]
    types = {f.name: f.dataType.simpleString() for f in full.schema}
    schema = ", ".join(f"`{c}` {types.get(c, 'bigint')}" for c in columns)
    return (
        full.groupBy(*call)
        .applyInPandas(numbered, schema)
        .withColumn("run_no", F.col("_no") + F.col("_offset"))
        .drop("_no", "_offset")
    )


def _of_pieces(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with the columns of their piece."""
    there = pieces.withColumnsRenamed({"video_id": "_v", "_piece": "_p"})
    return rows.join(there, F.col("video_id").eqNullSafe(F.col("_v")) & (F.col("_piece") == F.col("_p"))).drop("_v", "_p")


FRAME_COLUMNS = (
    "ord", "timestamp_sec", "section_index", "quality_score", "is_scene_boundary",
)


def collapse_runs(runs: DataFrame) -> DataFrame:
    """One frame per run: the sharpest (first on ties), with the interval of the whole run."""
    best = F.max_by(
        F.struct(*FRAME_COLUMNS),
        F.struct("quality_score", -F.col("timestamp_sec"), -F.col("ord")),
    )
    return (
        runs.groupBy("video_id", "run_no")
        .agg(
            best.alias("_best"),
            F.min("t_start").alias("t_start"),
            F.max("t_end").alias("t_end"),
            F.bool_or("is_scene_boundary").alias("_boundary"),
            F.count(F.lit(1)).alias("run_size"),
            F.max("n_runs").alias("n_runs"),
        )
        .select(
            "video_id",
            *[F.col(f"_best.{c}").alias(c) for c in FRAME_COLUMNS if c != "is_scene_boundary"],
            F.col("_boundary").alias("is_scene_boundary"),
            "t_start",
            "t_end",
            "run_size",
            "run_no",
            "n_runs",
        )
    )


def even_bucket(pos: Column, n: Column, target: int) -> Column:
    """Part of the even split a position falls in.

    Part b of T holds positions ``[b*n//T, (b+1)*n//T)``; the remainder is spread, unlike
    ``ntile``. With at most T rows every row is its own part.
    """
    if target <= 0:
        raise ValueError("target must be positive")
    part = F.floor(((pos + 1) * target - 1) / n).cast("bigint")
    return F.when(n <= target, pos).otherwise(part)


def even_cut_buckets(
    frames: DataFrame, target: int = FRAME_TARGET, slot_sec: float = TIME_SLOT_SEC
) -> DataFrame:
    """Add ``bucket``: the frames of a recording split by position into ``target`` even parts."""
    order = [F.col("timestamp_sec"), F.col("ord")]
    numbered = position(
        frames, ["video_id"], order, time_slot("timestamp_sec", slot_sec), "_pos", "_n"
    )
    return numbered.withColumn("bucket", even_bucket(F.col("_pos"), F.col("_n"), target)).drop("_pos", "_n")


def even_cut(
    frames: DataFrame, target: int = FRAME_TARGET, slot_sec: float = TIME_SLOT_SEC
) -> DataFrame:
    """The sharpest frame of every part (first on ties)."""
    return _sharpest(even_cut_buckets(frames, target, slot_sec), ["video_id", "bucket"])


def coverage_repair(merged: DataFrame, kept: DataFrame) -> DataFrame:
    """For each tenth of the timeline lost by a cut, the sharpest merged frame in it."""
    best = _sharpest(merged, ["video_id", "section_index"])
    return best.join(kept.select("video_id", "section_index").distinct(), ["video_id", "section_index"], "left_anti")


def cut_with_repair(bucketed: DataFrame) -> DataFrame:
    """Even cut and coverage repair in one pass over rows that know their ``bucket``.

    Each row enters two groups, its part and its tenth, and each group keeps its sharpest row,
    map-side combined. A tenth without a kept row gives its own best back. Adds ``repaired``.
    """
    columns = [c for c in bucketed.columns if c not in ("video_id", "bucket")]
    groups = F.array(
        F.struct(F.lit("part").alias("by"), F.col("bucket").cast("bigint").alias("no")),
        F.struct(F.lit("tenth").alias("by"), F.col("section_index").cast("bigint").alias("no")),
    )
    best = F.max_by(
        F.struct(*columns), F.struct("quality_score", -F.col("timestamp_sec"), -F.col("ord"))
    )
    winners = (
        bucketed.withColumn("_g", F.explode(groups))
        .groupBy("video_id", "_g")
        .agg(best.alias("_row"))
    )
    # At most one row per part and one per tenth are left of a recording.
    part, tenth = (F.col("_g.by") == by for by in ("part", "tenth"))
    tenths = winners.groupBy("video_id", F.col("_row.section_index").alias("_tenth")).agg(
        F.collect_list(F.when(part, F.col("_row"))).alias("_kept"),
        F.max(F.when(tenth, F.col("_row"))).alias("_best"),
    )
    lost = F.size("_kept") == 0
    return tenths.select(
        "video_id",
        lost.alias("repaired"),
        F.explode(F.when(lost, F.array("_best")).otherwise(F.col("_kept"))).alias("_row"),
    ).select("video_id", "_row.*", "repaired")


def downsample(
    frames: DataFrame,
    target: int = FRAME_TARGET,
    radius: int = NEAR_DUP_BITS,
    slot_sec: float = TIME_SLOT_SEC,
) -> DataFrame:
    """Merge near-duplicates, cut evenly over time, put lost tenths back.

    Runs follow each other in time, so the number of a run is the position of its frame and
    the cut needs no second numbering.
    """
    merged = collapse_runs(near_duplicate_runs(frames, radius, slot_sec))
    bucket = even_bucket(F.col("run_no"), F.col("n_runs"), target)
    return cut_with_repair(merged.withColumn("bucket", bucket)).drop("run_no", "n_runs")


def _sharpest(frames: DataFrame, group: list[str]) -> DataFrame:
    others = [c for c in frames.columns if c not in group]
    best = F.max_by(
        F.struct(*others), F.struct("quality_score", -F.col("timestamp_sec"), -F.col("ord"))
    )
    return frames.groupBy(*group).agg(best.alias("_best")).select(*group, "_best.*").select(*frames.columns)


NUMBERED_ID = r"^(?s)(.*?)(\d+)$"


def longest_id_run(ids: DataFrame, key: list[str], slot_rows: int = 1 << 20) -> DataFrame:
    """Per ``key``: the longest stretch of consecutive integers behind a common prefix.

    ``ids`` has one ``node_id`` per row. Suffixes longer than 38 digits do not fit a decimal
    and are counted in ``overlong`` instead.
    """
    numbered = ids.select(
        *key,
        F.regexp_extract("node_id", NUMBERED_ID, 1).alias("_prefix"),
        F.regexp_extract("node_id", NUMBERED_ID, 2).alias("_digits"),
    ).where("_digits <> ''").withColumn("_n", F.expr("try_cast(_digits AS decimal(38,0))"))
    distinct = numbered.select(*key, "_prefix", "_n").distinct()
    # Consecutive numbers keep the same distance to their rank.
    ranked = position(
        distinct.where("_n is not null"), [*key, "_prefix"], [F.col("_n")], F.floor(F.col("_n") / slot_rows), "_pos"
    )
    lengths = ranked.groupBy(*key, "_prefix", (F.col("_n") - F.col("_pos")).alias("_island")).agg(
        F.count(F.lit(1)).alias("_length")
    )
    longest = lengths.groupBy(*key).agg(F.max("_length").alias("longest_run"))
    overlong = numbered.groupBy(*key).agg(F.count_if(F.col("_n").isNull()).alias("overlong"))
    return overlong.join(longest, key, "left").select(
        *key, F.coalesce("longest_run", F.lit(0)).alias("longest_run"), "overlong"
    )


def longest_run_in(ids: Column) -> Column:
    """The same for the ids of one array, as an expression: no row leaves its task."""
    parts = F.transform(
        ids,
        lambda i: F.struct(
            F.regexp_extract(i, NUMBERED_ID, 1).alias("prefix"),
            F.regexp_extract(i, NUMBERED_ID, 2).try_cast("decimal(38,0)").alias("n"),
        ),
    )
    ordered = F.array_sort(F.array_distinct(F.filter(parts, lambda p: p["n"].isNotNull())))
    start = F.struct(
        F.lit(None).cast("struct<prefix:string,n:decimal(38,0)>").alias("last"),
        F.lit(0).alias("run"),
        F.lit(0).alias("best"),
    )

    def step(acc: Column, p: Column) -> Column:
        goes_on = (acc["last"]["prefix"] == p["prefix"]) & (acc["last"]["n"] + 1 == p["n"])
        run = F.when(F.coalesce(goes_on, F.lit(False)), acc["run"] + 1).otherwise(1)
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(ordered, start, step, lambda acc: acc["best"])


def cap_per_recording(frames: DataFrame, cap: int = SLIDE_CAP) -> DataFrame:
    """First ``cap`` slides per recording, in order."""
    in_order = Window.partitionBy("video_id").orderBy("timestamp_sec", "ord")
    return (
        frames.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= cap).drop("_n")
    )


def section_figure_ids(figures: DataFrame, slot_sec: float = TIME_SLOT_SEC) -> DataFrame:
    """``{video}_s{section}_{type}_{number}``, numbered by time inside each section and type."""
    numbered = position(
        figures,
        ["video_id", "section_index", "frame_type"],
        [F.col("timestamp_sec"), F.col("ord")],
        time_slot("timestamp_sec", slot_sec),
        "_n",
    )
    return numbered.withColumn(
        "figure_id",
        F.concat_ws(
            "_",
            F.col("video_id").cast("string"),
            F.format_string("s%02d", "section_index"),
            "frame_type",
            F.format_string("%03d", F.col("_n") + 1),
        ),
    ).drop("_n")
