"""Substring de-duplication by paragraphs: MinHash banding, exact verification, components.

Paragraphs are the lines of a text. Those of ``LEAST_WORDS`` words and more are sets of word
shingles. Bands are tuned for recall: with ``BANDS`` bands of ``ROWS`` values a pair at the
threshold meets with probability 0.99995, and what meets without being similar is
dropped by the exact comparison of the full sets. Similar paragraphs are joined to components;
of each component the first paragraph (by document id, then place) stays, all others are cut.

Defined results: null texts stay null and empty ones empty, both with nothing removed;
paragraphs with the same set are one node, so copies never multiply work; documents without an
id come last. Extra columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.bytewords import VISIBLE, distinct, find_words, mix, pieces, shingles
from cuesheet.llm.near_dedup import SHINGLE_WORDS, bucket_members, joined_buckets
from cuesheet.llm.rows import numbered, without_lines
from cuesheet.session import stored

LEAST_WORDS = 20
BANDS, ROWS = 12, 2
_SEEDS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS).astype(np.uint64) | np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _paragraphs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of a column of texts in a row, the text of each and its place there."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    counts = np.diff(lists.offsets.to_numpy())
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return lists.flatten(), text, place


def _sets_of(lines: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For bounded stretches of lines: which are long enough, their set hashes and offsets."""
    for part in pieces(pa.RecordBatch.from_arrays([lines], ["line"]), "line"):
        words = find_words(part.column(0), VISIBLE)
        hashes, owner = shingles(words, SHINGLE_WORDS)
        sets, bounds = distinct(hashes, owner, part.num_rows)
        yield words.counts >= LEAST_WORDS, sets, bounds


def min_hashes(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least value of each hash function over each set; sets must not be empty."""
    out = np.empty((len(bounds) - 1, len(_SEEDS)), np.uint64)
    base = mix(sets + _GOLDEN)
    for k, seed in enumerate(_SEEDS):
        drawn = base * seed
        out[:, k] = np.minimum.reduceat(drawn ^ (drawn >> np.uint64(29)), bounds[:-1])
    return out


def sketches(rows: DataFrame) -> DataFrame:
    """``(row, place, node, n, keys)`` of the long paragraphs of rows ``(_row, text)``; ``node``
    is the hash of the paragraph's set, ``keys`` has one key for each band."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                lines, text, place = _paragraphs(piece.column("text"))
                row = piece.column("_row").to_numpy()
                at = 0
                for long, sets, bounds in _sets_of(lines):
                    size = len(long)
                    kept = np.flatnonzero(long)
                    counts = np.diff(bounds)
                    inside = np.repeat(long, counts)
                    own = np.concatenate([[0], np.cumsum(counts[kept])])
                    if len(kept):
                        chosen = sets[inside]
                        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(chosen + _GOLDEN), dtype=np.uint64)])
                        node = mix(sums[own[1:]] - sums[own[:-1]] + counts[kept].astype(np.uint64)).view(np.int64)
                        values = min_hashes(chosen, own)
                        keys = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(kept), 1), np.uint64)
                        for r in range(ROWS):
                            keys = mix(keys * _GOLDEN + values[:, r::ROWS])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(row[text[at + kept]], pa.int64()),
                                pa.array(place[at + kept], pa.int32()),
                                pa.array(node),
                                pa.array(counts[kept], pa.int64()),
                                pa.ListArray.from_arrays(
                                    pa.array(np.arange(len(kept) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64))
                                ),
                            ],
                            ["row", "place", "node", "n", "keys"],
                        )
                    at += size

    return rows.select("_row", "text").mapInArrow(sketch, "row bigint, place int, node bigint, n bigint, keys array<bigint>")


def full_sets(rows: DataFrame) -> DataFrame:
    """``(node, set)`` of rows ``(text, wanted)``; ``wanted`` are structs of place and node."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                lines, text, _ = _paragraphs(piece.column("text"))
                first = np.searchsorted(text, np.arange(piece.num_rows))
                wanted = piece.column("wanted")
                counts = pc.list_value_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = wanted.flatten()
                places = flat.field("place").to_numpy() + np.repeat(first, counts)
                nodes = flat.field("node")
                at = 0
                for _, sets, bounds in _sets_of(lines.take(pa.array(places))):
                    size = len(bounds) - 1
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([nodes.slice(at, size), lists], ["node", "set"])
                    at += size

    return rows.select("text", "wanted").mapInArrow(build, "node bigint, set array<bigint>")


def repeated_paragraphs(rows: DataFrame) -> DataFrame:
    """``(row, removed)``: places of the paragraphs to cut from rows ``(_row, doc_id, text)``."""
    sketch = stored(sketches(rows))
    bands = sketch.select("node", "n", F.explode("keys").alias("key"))
    members = stored(bucket_members(bands).distinct())
    nodes = stored(members.select("node").distinct())
    shown = sketch.select("node", "row", "place").join(nodes, "node")
    shown = stored(shown.groupBy("node").agg(F.min("row").alias("row"))).join(
        stored(shown.groupBy("node", "row").agg(F.min("place").alias("place"))), ["node", "row"]
    )
    wanted = stored(shown.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("place", "node")).alias("wanted")))
    sets = stored(full_sets(rows.select("_row", "text").join(wanted.hint("merge"), "_row")))
    labels = joined_buckets(members, sets)

    # Components of several paragraphs, one set with several copies included.
    placed = sketch.select("node", "row", "place").join(labels, "node", "left")
    placed = stored(placed.select(F.coalesce("component", "node").alias("component"), "row", "place"))
    ids = rows.select(F.col("_row").alias("row"), "doc_id")
    several = stored(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component"))
    repeated = stored(placed.join(several, "component"))
    repeated = stored(repeated.join(ids.hint("merge"), "row"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")
    first = stored(repeated.groupBy("component").agg(F.min(order).alias("_f")))
    first = first.select("component", F.col("_f.row").alias("_first_row"), F.col("_f.place").alias("_first_place"))
    gone = repeated.join(first, "component").where("row <> _first_row or place <> _first_place")
    return stored(gone.select("row", "place")).groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("removed"))


def drop_repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``docs`` with cut ``text``, ``n_paragraphs`` (before), ``n_removed`` and ``removed``
    (their places, from 0)."""
    rows = numbered(docs.drop("n_paragraphs", "n_removed", "removed"))
    gone = repeated_paragraphs(rows.select("_row", "doc_id", "text"))
    return without_lines(rows, gone, "n_paragraphs")
