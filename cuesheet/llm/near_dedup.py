"""Near-duplicate groups of documents by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct word shingles. SuperMinHash draws, for every shingle, the
components of the signature in the order of a random permutation; the value drawn for the
j-th of them lies in [j, j + 1). As soon as every component of a document holds a value below
j + 1, later draws cannot lower it and the document is done, which for most documents is after
two or three draws for each shingle instead of one for each component.

Documents with the same set are one class. Classes that share a band of components meet in a
bucket and are compared with its pivot on their full sets; links are joined to components. A
bucket that still holds several components is worked off further, see ``joined_buckets``: in every
round linear in its size, however large it is.

Defined results: null and empty texts have an empty set, are linked with nothing and are kept;
equal rows are linked; a component is named by its least id (nulls never name one if
another member has an id); of rows with that id one is kept. Ids may repeat and be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.llm.bytewords import SMALL_PIECE_BYTES, VISIBLE, distinct, find_words, mix, pieces, shingles
from cuesheet.llm.components import components, joined
from cuesheet.llm.rows import numbered
from cuesheet.session import stored

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
# 32 bands of 4: a pair at the threshold meets in some band with probability 0.999995.
BANDS, ROWS = 32, 4
COMPONENTS = BANDS * ROWS
# Shingles drawn for at a time beyond the first draw, which bounds the permutations held.
DRAW = 1 << 17

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(hashes: np.ndarray, bounds: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """SuperMinHash signature of each text; ``bounds`` are the offsets of the texts' shingles.

    A text without shingles keeps infinite values.
    """
    texts = len(bounds) - 1
    out = np.full(texts * m, np.inf)
    # Texts are worked off in runs of about DRAW shingles, one longer text alone.
    start = 0
    while start < texts:
        end = int(np.searchsorted(bounds, bounds[start] + DRAW, "right")) - 1
        end = min(max(end, start + 1), texts)
        part = hashes[bounds[start] : bounds[end]].astype(np.uint64)
        text = np.repeat(np.arange(end - start), np.diff(bounds[start : end + 1]))
        _draw(part, text, out[start * m : end * m], m)
        start = end
    return out.reshape(texts, m)


def _draw(hashes: np.ndarray, text: np.ndarray, out: np.ndarray, m: int) -> None:
    """All draws for some texts, into their flat signatures ``out``."""
    order: np.ndarray | None = None
    seed = mix(hashes + _GOLDEN)
    for j in range(m):
        if not len(hashes):
            return
        drawn = mix(seed + np.uint64(j * int(_GOLDEN) % 2**64))
        # High bits give the value, low bits the place it is swapped in from.
        value = j + (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53
        swap = j + ((drawn & np.uint64(0x7FF)) * np.uint64(m - j) >> np.uint64(11)).astype(np.int64)
        rows = np.arange(len(hashes))
        if order is None:
            chosen = swap
        else:
            chosen = order[rows, swap].astype(np.int64)
        np.minimum.at(out, text * m + chosen, value)
        open_texts = (out.reshape(-1, m) >= j + 1).any(axis=1)
        stays = open_texts[text]
        if not stays.all():
            hashes, seed, text, swap, rows = hashes[stays], seed[stays], text[stays], swap[stays], None
            order = None if order is None else order[stays]
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint8), (len(hashes), 1))
        rows = np.arange(len(hashes))
        held = order[rows, swap].copy()
        order[rows, swap] = order[rows, j]
        order[rows, j] = held


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band of each signature; the band's number is part of it."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), np.uint64)
    for r in range(rows):
        key = mix(key * _GOLDEN + bits[:, :, r])
    return key.view(np.int64)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(column, VISIBLE)
    return distinct(*shingles(words, SHINGLE_WORDS), len(column))


def sketches(rows: DataFrame) -> DataFrame:
    """``(row, doc_id, n_shingles, set_hash, keys)`` of rows ``(_row, doc_id, text)``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE_BYTES):
                hashes, bounds = _sets(piece.column("text"))
                counts = np.diff(bounds)
                keys = band_keys(signatures(hashes, bounds))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + _GOLDEN), dtype=np.uint64)])
                whole = mix((sums[bounds[1:]] - sums[bounds[:-1]]) + counts.astype(np.uint64))
                # An empty set has no keys.
                kept = np.flatnonzero(counts > 0)
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("_row"),
                        piece.column("doc_id").cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(whole.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[kept].ravel())),
                    ],
                    ["row", "doc_id", "n_shingles", "set_hash", "keys"],
                )

    return rows.select("_row", "doc_id", "text").mapInArrow(
        sketch, "row bigint, doc_id bigint, n_shingles bigint, set_hash bigint, keys array<bigint>"
    )


def full_sets(rows: DataFrame) -> DataFrame:
    """``(node, set)`` of rows ``(_row, text)``: sorted hashes of the distinct shingles."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE_BYTES):
                hashes, bounds = _sets(piece.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("_row"), lists], ["node", "set"])

    return rows.select("_row", "text").mapInArrow(build, "node bigint, set array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("_a"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(a.hint("merge"), "a")
        .join(b.hint("merge"), "b")
        .select("a", "b", both.alias("_both"), (F.size("_a") + F.size("_b")).alias("_sum"))
        .where(F.col("_both") * 100 >= (F.col("_sum") - F.col("_both")) * SIMILAR_PERCENT)
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    found = _grouped(numbered(docs.select("doc_id", "text")))
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """``(row, doc_id, n_shingles, component_id, first_row)`` of numbered rows."""
    sketch = stored(sketches(rows))
    classes = stored(
        sketch.where("n_shingles > 0")
        .groupBy("set_hash")
        .agg(F.min("row").alias("node"), F.min("n_shingles").alias("n"))
    )
    reps = stored(
        sketch.select(F.col("row").alias("node"), "keys").join(classes.select("node", "n"), "node")
    )
    bands = reps.select("node", "n", F.explode("keys").alias("key"))
    members = stored(bucket_members(bands))
    nodes = members.select(F.col("node").alias("_row")).distinct()
    sets = stored(full_sets(rows.select("_row", "text").join(nodes.hint("merge"), "_row", "left_semi")))
    labels = joined_buckets(members, sets)

    grouped = classes.join(labels, "node", "left").select(
        "set_hash", F.coalesce("component", "node").alias("component")
    )
    grouped = stored(grouped)
    placed = stored(
        sketch.select("row", "doc_id", "n_shingles", "set_hash")
        .join(grouped, "set_hash", "left")
        .select("row", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("row")).alias("component"))
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    names = stored(placed.groupBy("component").agg(first.alias("_f")).select("component", F.col("_f.doc_id").alias("component_id"), F.col("_f.row").alias("first_row")))
    return placed.join(names, "component").select("row", "doc_id", "n_shingles", "component_id", "first_row")


def bucket_members(bands: DataFrame) -> DataFrame:
    """Rows ``(key, node, n)`` of keys with several nodes, with the least node as ``pivot``."""
    least = F.min(F.struct("node", "n"))
    buckets = bands.groupBy("key").agg(least.alias("_p"), F.max("node").alias("_other")).where("_p.node <> _other")
    buckets = stored(buckets.select("key", F.col("_p.node").alias("pivot"), F.col("_p.n").alias("pivot_n")))
    return bands.join(buckets, "key")


def joined_buckets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Components ``(node, component)`` of the members ``(key, node, n, pivot, pivot_n)`` of buckets.

    Buckets are compared with one pivot, those still mixed with another one of their own, which
    reaches what the first did not resemble. What is mixed then mostly shares a passage, or
    its members resemble each other but not enough. They are dealt to buckets of the rare
    shingles that similar sets must share, see ``_by_rare_shingles``, in which hardly any two below
    the threshold are compared and no two above it are missed. These are worked off with one,
    four, sixteen and more pivots until none is mixed.
    """
    others = members.where("node <> pivot")
    fits = _reachable(F.col("n"), F.col("n"), F.col("pivot_n"), F.col("pivot_n"))
    checked = stored(others.where(fits).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    labels = components(stored(confirmed(checked, sets)))
    active = others.select("key", "node", "n", F.col("n").alias("rest"))
    pivots, dealt = 1, False
    while True:
        left = stored(
            active.join(labels, "node", "left").select("key", "node", "n", "rest", F.coalesce("component", "node").alias("component"))
        )
        active = _mixed(left)
        if pivots > 1 and not dealt:
            nodes = stored(active.select("node", "n", "component").distinct())
            active = _mixed(_by_rare_shingles(nodes, sets))
            pivots, dealt = 1, True
        active = stored(active)
        if active.isEmpty():
            return labels
        if pivots == 1:
            # Nothing but these is compared from here on: rounds need not move the other sets.
            here = active.select("node").distinct()
            sets = stored(sets.join(here.hint("merge"), "node", "left_semi"))
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", "key"), "node"))
        chosen = stored(active.withColumn("_place", place).where(F.col("_place") <= pivots).drop("_place"))
        other = chosen.select("key", F.col("node").alias("_p"), F.col("component").alias("_c"), F.col("n").alias("_n"), F.col("rest").alias("_rest"))
        pairs = active.join(
            other,
            (active["key"] == other["key"])
            & (F.col("component") != F.col("_c"))
            & _reachable(F.col("rest"), F.col("n"), F.col("_rest"), F.col("_n")),
        ).select(F.least("_p", "node").alias("a"), F.greatest("_p", "node").alias("b"))
        fresh = stored(pairs.distinct().join(checked, ["a", "b"], "left_anti"))
        more = stored(confirmed(fresh, sets))
        checked = checked.unionByName(fresh)
        if not more.isEmpty():
            labels = joined(labels, more)
        active = active.drop("component").join(chosen.select("key", "node"), ["key", "node"], "left_anti")
        pivots *= 4


def _reachable(rest_a: Column, n_a: Column, rest_b: Column, n_b: Column) -> Column:
    """Whether two sets that can have at most ``rest`` shingles in common can be similar enough."""
    return F.least(rest_a, rest_b) * (100 + SIMILAR_PERCENT) >= (n_a + n_b) * SIMILAR_PERCENT


def _mixed(members: DataFrame) -> DataFrame:
    """Members ``(key, node, n, rest, component)`` of buckets of several components, without those
    that can be similar to nothing of the sizes there."""
    mixed = members.groupBy("key").agg(
        F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.min("n").alias("_least")
    )
    mixed = stored(mixed.where("_lo <> _hi").select("key", "_least"))
    smallest = F.greatest("_least", F.ceil(F.col("n") * SIMILAR_PERCENT / 100))
    return members.join(mixed, "key").where(_reachable(F.col("rest"), F.col("n"), F.col("rest"), smallest)).drop("_least")


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes ``(node, n, component)`` dealt to a bucket ``key`` for each of their rarest shingles.

    Sets are sorted by the number of nodes with a shingle, then by the shingle. Of two similar
    sets, the first shingle in common stands in both within the leading part that is returned,
    and all they have in common lies from there on: ``rest`` is the length from it to the end. So
    what changed in a copy, being rare, fills its leading part, and copies that changed too much
    for each other meet nowhere or with too little left.
    """
    whole = sets.join(nodes.hint("merge"), "node")
    shingle = whole.select("node", F.explode("set").alias("key"))
    shared = stored(shingle.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    sorted_ = shingle.join(shared.hint("merge"), "key").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "key"))).alias("_s")
    )
    sorted_ = sorted_.join(nodes.hint("merge"), "node")
    # A shingle of one node alone is left out of the list; it would stand before all others.
    at = sorted_.select("node", "n", "component", F.size("_s").alias("_m"), F.posexplode("_s").alias("_at", "_x"))
    at = at.select(F.col("_x.key").alias("key"), "node", "n", (F.col("_m") - F.col("_at")).cast("bigint").alias("rest"), "component")
    return stored(at.where(F.col("rest") * 100 >= F.col("n") * SIMILAR_PERCENT))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns kept, without all but one row of each component."""
    rows = numbered(docs)
    groups = _grouped(rows.select("_row", "doc_id", "text"))
    gone = groups.where("row <> first_row").select(F.col("row").alias("_row"))
    return rows.join(gone.hint("merge"), "_row", "left_anti").drop("_row")
