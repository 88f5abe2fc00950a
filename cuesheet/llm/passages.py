"""Repeated passages wherever they stand in a text: windows of words that several documents hold.

A window is a run of ``PASSAGE_WORDS`` words, A-Z lower-cased. A word is repeated if it stands in
a window that another document holds too, and removed if the first holder of such a window (by
document id, nulls last) is another document. So the first holder of a passage is marked and
keeps it, and each removed word stays in some earlier document. Lines play no part.

Windows are many, so few are ever moved. Each has an anchor, the least hash of its runs of
``ANCHOR_WORDS`` words; equal windows have equal anchors. Neighbouring windows with the same anchor
are one stretch, of some 16 windows on average. An anchor in one document only repeats nothing.
Where all holders of an anchor have the same stretch, all its windows are repeated. Only of the other
stretches, at the edges of passages, are single windows compared, once for equal stretches.
That is exact but for collisions of 64-bit hashes, and forms no pairs of documents.

Defined results: null texts stay null; texts of fewer words than a window repeat nothing. Extra
columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cuesheet.llm.bytewords import SMALL_PIECE_BYTES, VISIBLE, Words, find_words, pieces, run_hashes, utf8
from cuesheet.llm.rows import numbered
from cuesheet.session import stored

PASSAGE_WORDS = 51
ANCHOR_WORDS = 20
RESULTS = ("n_words", "n_repeated", "n_removed", "repeated", "removed")
_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def anchors(words: Words) -> np.ndarray:
    """Least hash of the runs of ``ANCHOR_WORDS`` words in each window, those across texts included."""
    least = run_hashes(words.hash, ANCHOR_WORDS)
    width, runs = 1, PASSAGE_WORDS - ANCHOR_WORDS + 1
    while width < runs:
        step = min(width, runs - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def stretches(rows: DataFrame) -> DataFrame:
    """``(holder, at, n, key, seg)`` of the stretches of rows ``(holder, text)``: first window, number
    of windows, anchor, and hash of all words of the stretch."""
    schema = T.StructType(
        [
            rows.schema["holder"],
            T.StructField("at", T.IntegerType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("key", T.LongType()),
            T.StructField("seg", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE_BYTES):
                words = find_words(piece.column("text"), VISIBLE)
                size = len(words.hash) - PASSAGE_WORDS + 1
                if size <= 0:
                    continue
                key = anchors(words)
                inside = words.text[:size] == words.text[PASSAGE_WORDS - 1 :]
                same = inside[1:] & inside[:-1] & (key[1:] == key[:-1])
                start = np.flatnonzero(inside & ~np.concatenate([[False], same]))
                end = np.flatnonzero(inside & ~np.concatenate([same, [False]])) + 1
                text = words.text[start]
                seg = run_hashes(words.hash, end - start + PASSAGE_WORDS - 1, start)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("holder").take(pa.array(text)),
                        pa.array(start - words.first[text], pa.int32()),
                        pa.array(end - start, pa.int32()),
                        pa.array(key[start].view(np.int64)),
                        pa.array(seg.view(np.int64)),
                    ],
                    ["holder", "at", "n", "key", "seg"],
                )

    return rows.select("holder", "text").mapInArrow(cut, schema)


def single_windows(rows: DataFrame) -> DataFrame:
    """``(seg, place, hash, first, last)`` of each window of the ``wanted`` stretches of rows
    ``(text, wanted)``; ``wanted`` are structs ``(at, n, seg, first, last)``."""
    wanted = rows.schema["wanted"].dataType.elementType
    schema = T.StructType(
        [wanted["seg"], T.StructField("place", T.IntegerType()), T.StructField("hash", T.LongType()), wanted["first"], wanted["last"]]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE_BYTES):
                words = find_words(piece.column("text"), VISIBLE)
                lists = piece.column("wanted")
                flat = lists.flatten()
                first = np.repeat(words.first[:-1], pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                n = flat.field("n").to_numpy().astype(np.int64)
                own = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                hashes = run_hashes(words.hash, PASSAGE_WORDS)[(first + flat.field("at").to_numpy())[own] + place]
                shown = flat.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [shown.field("seg"), pa.array(place, pa.int32()), pa.array(hashes.view(np.int64)), shown.field("first"), shown.field("last")],
                    ["seg", "place", "hash", "first", "last"],
                )

    return rows.select("text", "wanted").mapInArrow(cut, schema)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``(_row, spans)`` of rows ``(holder, text)``: ranges of windows that several documents hold,
    each with the row of its first holder. A holder is a struct that ends in ``_row``."""
    found = stored(stretches(rows))
    keys = found.groupBy("key").agg(
        F.min("holder._row").alias("low"), F.max("holder._row").alias("high"), (F.min("seg") != F.max("seg")).alias("mixed")
    )
    keys = stored(keys.where("low <> high").select("key", "mixed"))
    held = stored(found.join(keys, "key").select("holder", "at", "n", "seg", "mixed"))
    nodes = held.groupBy("seg").agg(
        F.min("holder").alias("first"),
        F.max("holder").alias("last"),
        F.min(F.struct("holder._row", "at")).alias("shown"),
        F.max("n").alias("n"),
        F.max("mixed").alias("mixed"),
    )
    nodes = stored(nodes)
    runs = nodes.where("not mixed").select("seg", F.col("first._row").alias("owner"), F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))

    wanted = nodes.where("mixed").groupBy(F.col("shown._row").alias("_row"))
    wanted = stored(wanted.agg(F.collect_list(F.struct("shown.at", "n", "seg", "first", "last")).alias("wanted")))
    texts = rows.select(F.col("holder._row").alias("_row"), "text")
    windows = stored(single_windows(texts.join(wanted.hint("merge"), "_row")))
    shared = windows.groupBy("hash").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    shared = stored(shared.where("first._row <> last._row").select("hash", F.col("first._row").alias("owner")))
    each = windows.select("seg", "place", "hash").join(shared, "hash").select("seg", "place", "owner")
    order = F.row_number().over(Window.partitionBy("seg", "owner").orderBy("place"))
    parts = each.withColumn("_gap", F.col("place") - order).groupBy("seg", "owner", "_gap")
    parts = parts.agg(F.min("place").alias("low"), F.max("place").alias("high")).drop("_gap")

    runs = stored(runs.unionByName(parts))
    spans = held.select("holder._row", "at", "seg").join(runs, "seg")
    span = F.struct((F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"), "owner")
    return stored(spans.groupBy("_row").agg(F.collect_list(span).alias("spans")))


def _covered(low: np.ndarray, high: np.ndarray, words: int) -> np.ndarray:
    """Which words stand in the windows from ``low`` to ``high``."""
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, low, 1)
    np.add.at(edges, high + PASSAGE_WORDS, -1)
    return np.cumsum(edges[:-1]) > 0


def _ranges(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the runs of ``chosen`` words in each text."""
    joined = chosen[1:] & chosen[:-1] & (words.text[1:] == words.text[:-1])
    start = np.flatnonzero(chosen & ~np.concatenate([[False], joined]))
    return start, np.flatnonzero(chosen & ~np.concatenate([joined, [False]])) + 1


def _listed(words: Words, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Runs of words as a list of each text, numbered within the text."""
    first = words.first[words.text[start]]
    flat = pa.StructArray.from_arrays([pa.array(start - first, pa.int32()), pa.array(end - first, pa.int32())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.first), pa.int32()), flat)


def _without(texts: pa.Array, words: Words, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts without runs of words and the white space behind each word."""
    data, offsets = utf8(texts)
    following = np.append(words.start, len(data))[end]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[words.start[start]] += 1
    np.subtract.at(edges, np.minimum(following, offsets[words.text[start] + 1]), 1)
    kept = np.cumsum(edges[:-1], dtype=np.int8) == 0
    counts = np.concatenate([[0], np.cumsum(kept)])
    rest = pa.StringArray.from_buffers(len(texts), pa.py_buffer(counts[offsets].astype(np.int32)), pa.py_buffer(data[kept]))
    return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), rest).cast(texts.type)


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with cut ``text``, ``n_words`` (before), ``n_repeated``, ``n_removed`` and the ranges
    ``repeated`` and ``removed`` of words (from 0, end exclusive)."""
    rows = numbered(docs.drop(*RESULTS))
    holder = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row").alias("holder")
    spans = repeated_windows(rows.select(holder, "text"))
    joined = rows.join(spans.hint("merge"), "_row", "left")
    passed = [c for c in rows.columns if c != "_row"]
    long = T.LongType()
    added = [T.StructField(name, kind) for name, kind in zip(RESULTS, (long, long, long, _RANGES, _RANGES), strict=True)]
    schema = T.StructType([rows.schema[c] for c in passed] + added)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE_BYTES):
                texts, lists = piece.column("text"), piece.column("spans")
                words = find_words(texts, VISIBLE)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                first, row = np.repeat(words.first[:-1], counts), np.repeat(piece.column("_row").to_numpy(), counts)
                low, high = first + flat.field("low").to_numpy(), first + flat.field("high").to_numpy()
                foreign = flat.field("owner").to_numpy() != row
                repeated = _ranges(words, _covered(low, high, len(words.hash)))
                removed = _ranges(words, _covered(low[foreign], high[foreign], len(words.hash)))
                sums = [np.bincount(words.text[s], e - s, piece.num_rows).astype(np.int64) for s, e in (repeated, removed)]
                out = {c: piece.column(c) for c in passed}
                out["text"] = _without(texts, words, *removed)
                out |= {"n_words": pa.array(words.counts, pa.int64()), "n_repeated": pa.array(sums[0]), "n_removed": pa.array(sums[1])}
                out |= {"repeated": _listed(words, *repeated), "removed": _listed(words, *removed)}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return joined.select("_row", *passed, "spans").mapInArrow(cut, schema)
