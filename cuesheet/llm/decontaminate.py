"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of all training tokens: each segment of documents keeps,
for every term, the sorted positions at which it stands. Segments are made and searched
independently of each other, so neither step shuffles postings and no term is gathered from
everywhere. A search takes the windows of the test set in blocks of bounded size. In every
segment it starts from the rarest term of each window and intersects the positions, adjusted by
the term's offset, with those of the next rarer terms. What remains are exact phrase matches.
``proximity_matches`` looks for all terms of a query within a span of words, in any order.

Terms are kept by 64-bit hash; phrase matches are confirmed on all terms of the window.

Defined results: null and empty texts have no words and no hits; an item without words has no
window; repeated windows count once; documents with equal or null ids are told apart by their
place in the index. Empty tables give empty results. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.bytewords import ALPHANUMERIC, SMALL_PIECE_BYTES, find_words, pieces
from cuesheet.session import stored

WINDOW = 10
# Words of the test set searched at a time; a block is broadcast.
BLOCK_WORDS = 1_000_000
# Unused positions between documents, so that no window reaches into the next one.
GAP = 64

INDEX_SCHEMA = (
    "segment bigint, doc_id array<bigint>, n_words array<int>, base array<int>, "
    "term array<bigint>, term_end array<int>, position array<int>"
)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def build_index(docs: DataFrame) -> DataFrame:
    """Index of ``docs (doc_id, text)``: one row per segment, every token's position in it.

    ``base`` is the position of each document's first word; positions of ``term[i]`` are
    ``position[term_end[i - 1] : term_end[i]]``, ascending.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE_BYTES):
                words = find_words(piece.column("text"), ALPHANUMERIC)
                counts = words.counts
                base = np.concatenate([[0], np.cumsum(counts + GAP)[:-1]]).astype(np.int64)
                position = np.arange(len(words.hash)) + GAP * words.text
                order = np.argsort(words.hash, kind="stable")
                terms = words.hash[order]
                last = np.flatnonzero(np.concatenate([terms[1:] != terms[:-1], [True]])) if len(terms) else order
                ids = piece.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())),
                        _lists(counts, pa.int32()),
                        _lists(base, pa.int32()),
                        _lists(terms[last].view(np.int64), pa.int64()),
                        _lists(last + 1, pa.int32()),
                        _lists(position[order], pa.int32()),
                    ],
                    ["segment", "doc_id", "n_words", "base", "term", "term_end", "position"],
                )
                number += 1

    return stored(docs.select("doc_id", "text").mapInArrow(segments, INDEX_SCHEMA))


class Segment:
    """Postings of one segment, with the look-ups a search needs."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def values(name: str) -> np.ndarray:
            return batch.column(batch.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False)

        self.doc_id = batch.column(batch.schema.get_field_index("doc_id"))[row].values
        self.n_words = values("n_words").astype(np.int64)
        self.base = values("base").astype(np.int64)
        self.term = values("term").view(np.uint64)
        self.end = values("term_end").astype(np.int64)
        self.position = values("position").astype(np.int64)
        self.start = np.concatenate([[0], self.end[:-1]]) if len(self.end) else self.end
        self.width = int(self.base[-1] + self.n_words[-1] + GAP) if len(self.base) else 1
        # Term number and position in one ascending key: a look-up is one binary search.
        owner = np.repeat(np.arange(len(self.term)), self.end - self.start)
        self.key = owner * self.width + self.position

    def ranks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each term in this segment and how often it stands there (0: never)."""
        at = np.minimum(np.searchsorted(self.term, terms), max(len(self.term) - 1, 0))
        if not len(self.term):
            return at, np.zeros(terms.shape, np.int64)
        return at, np.where(self.term[at] == terms, (self.end - self.start)[at], 0)

    def stands(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = rank * self.width + position
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return (self.key[at] == wanted) & (position >= 0)

    def next_after(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        """First position of a term at or after another; the segment's width if there is none."""
        at = np.searchsorted(self.key, rank * self.width + np.maximum(position, 0))
        found = np.minimum(at, len(self.key) - 1)
        inside = (at < len(self.key)) & (self.key[found] // self.width == rank)
        return np.where(inside, self.key[found] % self.width, self.width)

    def expand(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each of the terms, with the place of the term in ``rank``."""
        count = (self.end - self.start)[rank]
        owner = np.repeat(np.arange(len(rank)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, self.position[self.start[rank][owner] + inner]

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window number and start of every occurrence of windows of one length."""
        rank, count = self.ranks(windows)
        alive = np.flatnonzero(count.min(axis=1) > 0) if len(windows) else np.zeros(0, np.int64)
        if not len(alive):
            return alive, alive
        rank, rarest_first = rank[alive], np.argsort(count[alive], axis=1, kind="stable")
        rows = np.arange(len(alive))
        owner, where = self.expand(rank[rows, rarest_first[:, 0]])
        start = where - rarest_first[owner, 0]
        for k in range(1, windows.shape[1]):
            offset = rarest_first[owner, k]
            stays = self.stands(rank[owner, offset], start + offset)
            owner, start = owner[stays], start[stays]
        return alive[owner], start

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Starts of the runs of ``span`` words that begin with a term and hold all ``terms``."""
        rank, count = self.ranks(terms)
        if not len(terms) or count.min() == 0:
            return np.zeros(0, np.int64)
        by_count = np.argsort(count, kind="stable")
        _, rarest = self.expand(rank[by_count[:1]])
        # A run that holds the rarest term starts at most span - 1 words before it.
        start = np.unique((rarest[:, None] - np.arange(span)).ravel())
        start = start[start >= 0]
        for k in by_count:
            start = start[self.next_after(np.full(len(start), rank[k]), start) < start + span]
        begins = np.zeros(len(start), bool)
        for k in range(len(terms)):
            begins |= self.stands(np.full(len(start), rank[k]), start)
        return start[begins]


def windows_of(items: list[tuple[str, str | None]], size: int) -> list[tuple[str, np.ndarray]]:
    """Windows of each item as hashed terms: ``size`` consecutive words, a shorter item whole."""
    words = find_words(pa.array([t or "" for _, t in items], pa.string()), ALPHANUMERIC)
    found = []
    for i, (item, _) in enumerate(items):
        own = words.hash[words.first[i] : words.first[i + 1]]
        if len(own):
            width = min(size, len(own))
            found.append((item, np.lib.stride_tricks.sliding_window_view(own, width)))
    return found


def blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str | None]]]:
    """Items ``(item_id string, text)`` in blocks of bounded size; a longer item is a block alone."""
    block, size = [], 0
    for row in items.toLocalIterator():
        length = len(row["text"] or "") // 2 + 1
        if block and size + length > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += length
    if block:
        yield block


def phrase_hits(index: DataFrame, block: list[tuple[str, str | None]], size: int = WINDOW) -> DataFrame:
    """Exact matches of a block of items: for every document with one, the hit words as ranges
    ``lo`` and ``hi`` (exclusive, counted from its first word) and the items found."""
    found = windows_of(block, size)
    tables: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
    for width in {w.shape[1] for _, w in found}:
        rows = np.concatenate([w for _, w in found if w.shape[1] == width])
        owner = [item for item, w in found if w.shape[1] == width for _ in range(len(w))]
        unique, back = np.unique(rows, axis=0, return_inverse=True)
        items: list[list[str]] = [[] for _ in range(len(unique))]
        for item, at in zip(owner, back.ravel(), strict=True):
            items[at].append(item)
        tables[width] = unique, [sorted(set(i)) for i in items]
    shared = index.sparkSession.sparkContext.broadcast(tables)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row)
                number = batch.column(batch.schema.get_field_index("segment"))[row].as_py()
                hits: dict[int, tuple[list[np.ndarray], set[str]]] = {}
                for width, (rows, items) in shared.value.items():
                    which, start = segment.phrases(rows)
                    doc = np.searchsorted(segment.base, start, "right") - 1
                    inside = start + width <= segment.base[doc] + segment.n_words[doc] if len(doc) else doc > 0
                    which, start, doc = which[inside], start[inside], doc[inside]
                    order = np.argsort(doc, kind="stable")
                    edges = np.flatnonzero(np.diff(doc[order])) + 1
                    for part in np.split(order, edges) if len(order) else []:
                        d = int(doc[part[0]])
                        ranges, names = hits.setdefault(d, ([], set()))
                        at = start[part] - segment.base[d]
                        ranges.append(np.stack([at, at + width], axis=1))
                        for w in np.unique(which[part]):
                            names.update(items[w])
                if hits:
                    merged = {d: _merge(np.concatenate(r)) for d, (r, _) in hits.items()}
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * len(hits), pa.int64()),
                            pa.array(list(hits), pa.int32()),
                            pa.array([[{"lo": int(a), "hi": int(b)} for a, b in merged[d]] for d in hits], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                            pa.array([sorted(n) for _, n in hits.values()], pa.list_(pa.string())),
                        ],
                        ["segment", "place", "ranges", "items"],
                    )

    schema = "segment bigint, place int, ranges array<struct<lo:int,hi:int>>, items array<string>"
    return index.mapInArrow(search, schema)


def _merge(ranges: np.ndarray) -> np.ndarray:
    """Ranges joined where they touch, ascending."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    return np.stack([ranges[first, 0], np.maximum.reduceat(ranges[:, 1], np.flatnonzero(first))], axis=1)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document of ``docs (doc_id, text)`` what ``items (item_id, text)`` it contains.

    Columns: ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items``,
    ``items_sha256`` (digest of the sorted item ids), ``contaminated``, ``hit_ranges`` and
    ``hit_items``. A document appears once for every row of ``docs``.
    """
    return _summary(build_index(docs), items, size)


def _summary(index: DataFrame, items: DataFrame, size: int) -> DataFrame:
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    found = [phrase_hits(index, block, size) for block in blocks(named)]
    zipped = F.arrays_zip(F.col("doc_id"), F.col("n_words"))
    docs = index.select("segment", F.posexplode(zipped).alias("place", "_d")).select(
        "segment", "place", F.col("_d.doc_id").alias("doc_id"), F.col("_d.n_words").cast("bigint").alias("n_words")
    )
    if not found:
        found = [index.sparkSession.createDataFrame([], "segment bigint, place int, ranges array<struct<lo:int,hi:int>>, items array<string>")]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    # A document found by several blocks has one row for each: join their ranges and items.
    each = hits.groupBy("segment", "place").agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("_r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("hit_items"),
    )
    joined = F.expr(
        "aggregate(_r, array(named_struct('lo', -1, 'hi', -1)), (a, r) -> "
        "if(r.lo > element_at(a, -1).hi, concat(a, array(r)), "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('lo', element_at(a, -1).lo, "
        "'hi', greatest(element_at(a, -1).hi, r.hi))))))"
    )
    each = each.withColumn("_m", joined).select(
        "segment", "place", "hit_items", F.expr("filter(_m, r -> r.lo >= 0)").alias("hit_ranges")
    )
    n_hit = F.expr("aggregate(hit_ranges, 0L, (n, r) -> n + r.hi - r.lo)")
    return docs.join(each, ["segment", "place"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("hit_items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("hit_items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("hit_items").isNotNull().alias("contaminated"),
        "hit_ranges",
        "hit_items",
    )


def proximity_matches(index: DataFrame, queries: list[tuple[str, str]], span: int) -> DataFrame:
    """Places where all words of a query stand within ``span`` words, in any order.

    ``queries`` are ``(name, words)``, a bounded list; rows are ``(name, doc_id, at)`` with the
    number of the word that the run of words begins with.
    """
    if span > GAP:
        raise ValueError(f"span is at most {GAP}")
    hashed = find_words(pa.array([q for _, q in queries], pa.string()), ALPHANUMERIC)
    terms = {name: np.unique(hashed.hash[hashed.first[i] : hashed.first[i + 1]]) for i, (name, _) in enumerate(queries)}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row)
                for name, own in terms.items():
                    start = segment.near(own, span)
                    doc = np.searchsorted(segment.base, start, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(start), pa.string()),
                            segment.doc_id.take(pa.array(doc)),
                            pa.array(start - segment.base[doc], pa.int64()),
                        ],
                        ["name", "doc_id", "at"],
                    )

    return index.mapInArrow(search, "name string, doc_id bigint, at bigint")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` that contain no window of any item, all columns kept."""
    from cuesheet.llm.rows import numbered

    rows = numbered(docs)
    index = build_index(rows.select(F.col("_row").alias("doc_id"), "text"))
    bad = _summary(index, items, size).where("contaminated").select(F.col("doc_id").alias("_row"))
    return rows.join(bad.hint("merge"), "_row", "left_anti").drop("_row")
