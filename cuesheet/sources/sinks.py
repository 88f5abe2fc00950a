"""Sinks (K family): what a table holds afterwards, as a plan, and repeatable writers.

Keyed tables live in a ``Store``: a write reads and rewrites only the hash buckets its keys fall in,
and tables written together become visible together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.text import leaf_name, mask_video
from cuesheet.operators.gates import job_row_reasons
from cuesheet.sources.store import Change, Store

DECK_KEY = ("video_id", "generator_version")
# Units of a second in stored time keys: two readings of one time are one key.
TIME_SCALE = 1_000_000


def one_per_key(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row of each key: the first by its other columns in their order, nulls last."""
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(*[x for c in rest for x in (F.col(c).isNull(), F.col(c))])
    first = F.min_by(F.struct(*rest), order).alias("_first")
    return rows.groupBy(*key).agg(first).select(*key, "_first.*").select(*rows.columns)


def upsert_decks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Deck table after a build: rebuilt decks go back to ``building`` with a cleared error.

    An owner is kept when the new row names none. ``created`` tells new keys. Of several new rows of one key one
    counts (see ``one_per_key``).
    """
    e, n = existing.alias("e"), one_per_key(new, DECK_KEY).withColumn("_new", F.lit(True)).alias("n")
    both = e.join(n, list(DECK_KEY), "full_outer")
    touched = F.coalesce(F.col("_new"), F.lit(False))

    def newer(column: str):
        return F.when(touched, F.col(f"n.{column}")).otherwise(F.col(f"e.{column}"))

    return both.select(
        *DECK_KEY,
        F.coalesce("e.deck_id", "n.deck_id").alias("deck_id"),
        newer("lang").alias("lang"),
        newer("v2_fingerprint").alias("v2_fingerprint"),
        newer("slide_count").alias("slide_count"),
        F.when(touched, "building").otherwise(F.col("e.status")).alias("status"),
        F.when(~touched, F.col("e.error")).alias("error"),
        F.coalesce("n.user_id", "e.user_id").alias("user_id"),
        (touched & F.col("e.deck_id").isNull()).alias("created"),
    )


def replace_rows(existing: DataFrame, new: DataFrame, decks: DataFrame) -> DataFrame:
    """Rows of the rebuilt ``decks`` replaced as a whole, also when a deck has none now."""
    kept = existing.join(decks.select("deck_id").distinct(), "deck_id", "left_anti")
    return kept.unionByName(new)


def detach_figures(figures: DataFrame, decks: DataFrame) -> DataFrame:
    """Figures of rebuilt decks lose their slide before the slides go."""
    marked = decks.select("deck_id").distinct().withColumn("_rebuilt", F.lit(True))
    return (
        figures.join(marked, "deck_id", "left")
        .withColumn("slide_id", F.when(F.col("_rebuilt").isNull(), F.col("slide_id")))
        .drop("_rebuilt")
    )


def time_key(seconds: Column) -> Column:
    """A time in whole microseconds: stored times are compared as whole numbers."""
    return F.round(seconds * TIME_SCALE).cast("bigint")


def unseen(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows whose natural key is not stored yet, each once: a rerun appends nothing.

    Of rows with one key the first by ``ord``, then by the other columns, is the one on every run. Times, the
    key columns whose names end in ``_sec``, are compared in whole microseconds.
    """
    rest = [c for c in new.columns if c not in key]
    order = [c for c in rest if c == "ord"] + [c for c in rest if c != "ord"]
    marks = [time_key(F.col(c)).alias(f"_k{i}") if c.endswith("_sec") else F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]
    names = [f"_k{i}" for i in range(len(key))]
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order, *key))
    first = new.select("*", *marks).withColumn("_place", place).where("_place = 1")
    return without(first, existing.select(*marks), names).select(*new.columns)


def without(rows: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` whose key is not in ``stored``; nulls in a key are equal."""
    there = stored.select(*[F.col(c).alias(f"_there{i}") for i, c in enumerate(key)])
    same = [F.col(c).eqNullSafe(F.col(f"_there{i}")) for i, c in enumerate(key)]
    return rows.join(there, reduce(and_, same), "left_anti")


KEYFRAME_KEY = ("video_id", "timestamp_sec")
SEGMENT_KEY = ("video_id", "from_sec", "to_sec")


def unseen_keyframes(new: DataFrame, existing: DataFrame) -> DataFrame:
    return unseen(new, existing, KEYFRAME_KEY)


def unseen_caption_segments(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Caption text is not stored, only times, embedding and the boundary flag."""
    return unseen(new.drop("text"), existing, SEGMENT_KEY)


def checked_jobs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows inside the value domains, attempt budget defaulted, and violations with reasons."""
    judged = rows.withColumns(
        {"max_attempts": F.coalesce("max_attempts", F.lit(2)), "violations": job_row_reasons()}
    )
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def artifact_rows(rows: DataFrame) -> DataFrame:
    """Stage artifacts ready to publish: leaf file names, ids masked by the label."""
    return rows.select(
        "stage",
        "label",
        leaf_name(F.col("path")).alias("file_name"),
        mask_video(F.col("message"), F.col("video_id"), F.col("label")).alias("message"),
    )


# --- writers --------------------------------------------------------------------------------


def save_decks(store: Store, decks: DataFrame, slides: DataFrame | None = None, figures: DataFrame | None = None) -> int:
    """Write a build: upsert ``decks``, replace the slides of those decks, then their figures.

    ``slides`` and ``figures`` name their deck by ``DECK_KEY``; they get the id of the stored deck. Without
    ``figures`` the decks' stored figures stay but lose their slide, before the slides go. Only
    buckets of the decks written are read and rewritten, and one commit shows all three tables at once. Written
    again, a build leaves the same tables. Returns the new version.
    """
    since = store.record()["version"]
    touched = store.touched(decks, DECK_KEY)
    shape = upsert_decks(decks, decks).drop("created").schema
    upserted = upsert_decks(store.read("decks", touched, shape), decks).drop("created")
    # The ids come from the files just written: a new id may be random, so it is computed once.
    files = store.write_files("decks", upserted, DECK_KEY)
    written = store.read_files("decks", files, shape)
    built = written.join(decks.select(*DECK_KEY).distinct(), list(DECK_KEY), "left_semi").select(*DECK_KEY, "deck_id")
    changes = [Change("decks", written, DECK_KEY, touched, files)]
    parts = store.touched(built, ["deck_id"])

    def of_deck(rows: DataFrame) -> DataFrame:
        return rows.join(built, list(DECK_KEY)).drop(*DECK_KEY)

    if slides is not None:
        fresh = of_deck(slides)
        old = store.read("slides", parts, fresh.schema)
        changes.append(Change("slides", replace_rows(old, fresh, built), ["deck_id"], parts))
    if figures is not None:
        fresh = of_deck(figures)
        old = store.read("figures", parts, fresh.schema)
        changes.append(Change("figures", replace_rows(old, fresh, built), ["deck_id"], parts))
    elif slides is not None and store.has("figures"):
        changes.append(Change("figures", detach_figures(store.read("figures", parts), built), ["deck_id"], parts))
    return store.commit(changes, since=since)


# Bits of the filter for each new key, and at most: two megabytes.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 24


def key_filter(keys: DataFrame, key: Sequence[str]) -> Column:
    """A test on the columns ``key`` that every row of ``keys`` passes and most others do not.

    A Bloom filter with two hashes, built by aggregation into words of 48 bits and held as one binary
    literal of bounded size; an overfull filter lets more rows pass, never fewer.
    """
    count = keys.count()
    bits = 1 << max(10, min(MOST_FILTER_BITS, count * FILTER_BITS).bit_length())
    bits = min(bits, MOST_FILTER_BITS)

    def places() -> list[Column]:
        return [F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]

    hits = keys.select(F.explode(F.array(*places())).alias("p")).groupBy(F.floor(F.col("p") / 48).alias("word"))
    words = hits.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 48).cast("int"))).alias("set")).collect()
    held = bytearray((bits // 48 + 1) * 6)
    for r in words:
        held[r["word"] * 6 : r["word"] * 6 + 6] = r["set"].to_bytes(6, "little")
    table = F.lit(held)

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(table, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte.cast("bigint"), (place % 8).cast("int")) == 1

    first, second = places()
    return F.coalesce(is_set(first) & is_set(second), F.lit(False))


def append_unseen(store: Store, table: str, new: DataFrame, key: Sequence[str], batch: tuple[str, int | str]) -> int:
    """Append the rows of ``new`` whose key is not stored yet, under the name of their ``batch``.

    Times in ``key`` (names ending in ``_sec``) are stored beside the row in whole microseconds, as
    ``<name>_us``, and rows are put in buckets of these keys. Stored keys are read only in the buckets that
    new keys fall in, through a Bloom filter of the new keys, and only their columns. A batch that is committed
    already is not looked at again; under another name its rows are found stored. Returns the version.
    """
    record = store.record()
    if record["batches"].get(batch[0]) == batch[1]:
        return record["version"]
    names = [f"{c}_us" if c.endswith("_sec") else c for c in key]
    marked = new.withColumns({n: time_key(F.col(c)) for n, c in zip(names, key) if n != c})
    touched = store.touched(marked, names)
    if store.has(table):
        keys = marked.select(*names).distinct()
        stored_keys = store.read(table, touched).select(*names).where(key_filter(keys, names))
    else:
        stored_keys = marked.select(*names).limit(0)
    rest = [c for c in marked.columns if c not in names]
    order = [c for c in rest if c == "ord"] + [c for c in rest if c != "ord"]
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    fresh = without(marked.withColumn("_place", place).where("_place = 1"), stored_keys, names)
    return store.commit([Change(table, fresh.select(*marked.columns), names)], batch, record["version"])


def overwrite_touched(df: DataFrame, path: str, partitions: Sequence[str], fmt: str = "parquet") -> None:
    """Overwrite only the partitions present in ``df``; safe to run again.

    The rows are spread over writers by partition and a salt taken from the row itself, so a
    hot partition is written by several tasks and a retried task writes the same rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    (
        salted.repartition(*partitions, "_salt")
        .drop("_salt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .format(fmt)
        .save(path)
    )


def write_artifacts(rows: DataFrame, path: str) -> None:
    overwrite_touched(artifact_rows(rows), path, ["stage", "label"], "json")


def write_report(gates: DataFrame, families: DataFrame, runs: DataFrame, path: str) -> None:
    """Gate and family tables and the raw runs, as Parquet; the two small ones also as JSON."""
    for name, table in (("gates", gates), ("families", families)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        table.write.mode("overwrite").json(f"{path}/{name}_json")
    runs.write.mode("overwrite").parquet(f"{path}/runs")
