"""Line de-duplication by pairwise alignment.

Every line hash names the earliest document that holds it; a later document and the holder of
one of its lines are a pair. So a line that thousands share makes thousands of pairs
with one holder, never pairs of all sharers. Runs of lines name their earliest holder in the same
way: from every line the shortest run forward and the shortest backward that has ``LEAST_CHARS``
characters. Every block that is long enough is covered by such runs, so it meets a document that
holds it also when third documents were the first with each of its lines. A document is aligned
with its partners in the order of their rarest shared line. Alignment is patience diff: lines that
stand once in either document, in the longest run of ascending places, are anchors; from anchors it
extends over equal neighbours. An aligned block of consecutive lines with ``LEAST_CHARS``
characters and more is deleted from the later document; then runs and long lines that stand
between the deleted blocks in both documents are, repeated ones too: the n-th with the n-th. So a
document that holds a passage once takes it once from a later document that holds it twice.

Defined results: null texts stay null; blank lines are never shared; white space around a line
does not matter; documents are ordered by id (null last), equal ids by place in the table, so
of repeated rows the first stays whole. Ties between partners go to the earlier one. Extra columns
pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cuesheet.llm.bytewords import mix
from cuesheet.llm.rows import numbered, without_lines
from cuesheet.session import stored

LEAST_CHARS = 60
# Odd, so that it has an inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given by ascending first place, whose second places ascend."""
    tops: list[int] = []
    held: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before[n] = held[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            held.append(n)
        else:
            tops[pile], held[pile] = j, n
    run, n = [], held[-1] if held else -1
    while n >= 0:
        run.append(pairs[n])
        n = before[n]
    return run[::-1]


def runs_of_lines(hashes: np.ndarray, chars: np.ndarray, owner: np.ndarray, least_chars: int = LEAST_CHARS):
    """First places, lengths and hashes of the runs of two lines and more, over lines laid end to end.

    Blank lines have no ``chars``; no run goes over one or from one ``owner`` to the next.
    """
    n = len(chars)
    total = np.concatenate([[0], np.cumsum(chars)])
    piece = np.cumsum((chars == 0) | np.append(True, owner[1:] != owner[:-1])[:n])
    places = np.flatnonzero(chars > 0)
    ends = np.searchsorted(total, total[places] + least_chars, "left") - 1
    starts = np.searchsorted(total, total[places + 1] - least_chars, "right") - 1
    first = np.concatenate([places[ends < n], starts[starts >= 0]])
    last = np.concatenate([ends[ends < n], places[starts >= 0]])
    good = (piece[first] == piece[last]) & (last > first)
    first, last = np.unique(np.stack([first[good], last[good]]), axis=1)
    powers = np.cumprod(np.append(np.uint64(1), np.full(n, BASE, np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)))
    summed = np.append(np.uint64(0), np.cumsum(hashes.astype(np.uint64) * powers[:n]))
    code = (summed[last + 1] - summed[first]) * back[first] + (last - first + 1).astype(np.uint64)
    return first, last - first + 1, mix(code).view(np.int64)


def between(units: list[tuple[int, int, list[int]]], kept: dict[int, int]) -> None:
    """Add to ``kept`` (place to the partner's place) the units that fit between its blocks.

    A unit is a first place, a number of lines and its first places in the partner. Between the
    same blocks the n-th of equal units goes with the n-th place, in the longest ascending run,
    and anew in the gaps this leaves until nothing is added.
    """
    added = True
    while added:
        added = False
        mine = sorted(kept)
        seen: Counter = Counter()
        fits = []
        for i, k, places in units:
            if all(x in kept for x in range(i, i + k)):
                continue
            low, high = bisect_left(mine, i), bisect_left(mine, i + k)
            a = bisect_right(places, kept[mine[low - 1]]) if low else 0
            b = bisect_right(places, kept[mine[high]] - k) if high < len(mine) else len(places)
            n = seen[low, high, k, places[0]]
            seen[low, high, k, places[0]] += 1
            if a + n < b:
                fits.append((i, places[a + n], k))
        fits.sort(key=lambda x: (x[0], -x[1], -x[2]))
        length = {(i, j): k for i, j, k in reversed(fits)}
        taken = set(kept.values())
        for i, j in ascending([x[:2] for x in fits]):
            new = {i + t: j + t for t in range(length[i, j]) if i + t not in kept}
            if new and taken.isdisjoint(new.values()):
                kept.update(new)
                taken.update(new.values())
                added = True


def aligned_lines(shared: list[dict], least_chars: int = LEAST_CHARS) -> list[int]:
    """Places of the lines to delete from one document.

    ``shared`` are its lines that an earlier document holds: place ``i``, ``chars``, hashes of the
    lines around it ``before`` and ``after``, and of the holder: ``partner`` (its order), place
    ``j`` and all ``places``, ``once`` (the line stands once in it), ``holder_before`` and
    ``holder_after``; ``df`` is the number of documents with the line. With ``k`` above 1 it is a run
    of so many lines.
    """
    chars = {s["i"]: s["chars"] for s in shared if s.get("k", 1) == 1}
    partners: dict[int, list[dict]] = defaultdict(list)
    for s in shared:
        partners[s["partner"]].append(s)
    gone: set[int] = set()
    for _, units in sorted(partners.items(), key=lambda p: (min(s["df"] for s in p[1]), p[0])):
        units.sort(key=lambda s: s["i"])
        lines = [s for s in units if s.get("k", 1) == 1]
        often = Counter(s["j"] for s in lines)
        at = {(s["i"], s["j"]): s for s in lines}
        anchors = ascending([(s["i"], s["j"]) for s in lines if s["once"] and often[s["j"]] == 1])
        matched = dict(anchors)
        taken = set(matched.values())
        for step, here, there in ((1, "after", "holder_after"), (-1, "before", "holder_before")):
            for i, j in anchors if step > 0 else anchors[::-1]:
                line = at[i, j]
                # On as long as the next lines are equal; the last one may be held by a third.
                while line is not None and line[here] is not None and line[here] == line[there]:
                    i, j = i + step, j + step
                    if i in matched or j in taken:
                        break
                    matched[i] = j
                    taken.add(j)
                    line = at.get((i, j))
        kept: dict[int, int] = {}
        block: list[int] = []
        for i in [*sorted(matched), None]:
            if block and (i is None or i != block[-1] + 1 or matched[i] != matched[block[-1]] + 1):
                if sum(chars.get(x, 0) for x in block) >= least_chars:
                    kept.update((x, matched[x]) for x in block)
                block = []
            if i is not None:
                block.append(i)
        long = [s for s in units if s.get("k", 1) > 1 or s["chars"] >= least_chars]
        between([(s["i"], s.get("k", 1), s.get("places") or [s["j"]]) for s in long], kept)
        gone.update(kept)
    return sorted(gone)


def aligned(lists: DataFrame) -> DataFrame:
    """``(row, removed)`` of rows ``(row, shared)`` that have lines to delete."""

    # Rows pass through: a filter on the verdict of a column function would be pushed below it, and
    # Spark would align every document twice, in two workers a task.
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One document's lines at a time are Python values.
            found = [aligned_lines(x.as_py()) for x in batch.column(1)]
            removed = pa.array(found, pa.list_(pa.int32()))
            made = pa.RecordBatch.from_arrays([batch.column(0), removed], ["row", "removed"])
            yield made.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return lists.select("row", "shared").mapInArrow(align, "row bigint, removed array<int>")


_RUN = StructType([StructField("i", IntegerType()), StructField("k", IntegerType()), StructField("h", LongType())])


@F.arrow_udf(ArrayType(_RUN))
def _runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for hashes, chars in batches:
        sizes = hashes.value_lengths().to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = [x.flatten().fill_null(0).to_numpy(zero_copy_only=False) for x in (hashes, chars)]
        first, k, code = runs_of_lines(*flat, np.repeat(np.arange(len(sizes)), sizes))
        own = np.searchsorted(bounds, first, "right") - 1
        at = pa.array(np.searchsorted(first, bounds), pa.int32())
        found = [pa.array(first - bounds[own], pa.int32()), pa.array(k, pa.int32()), pa.array(code, pa.int64())]
        yield pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(found, ["i", "k", "h"]))


def common_blocks(rows: DataFrame) -> DataFrame:
    """``(row, removed)``: places of the lines to delete from rows ``(_row, doc_id, text)``."""
    hashed = F.expr(
        r"transform(split(text, '\n'), x -> if(trim(x) = '', null, named_struct('h', xxhash64(trim(x)), 'chars', length(trim(x)))))"
    )
    around = F.expr(
        "transform(_l, (x, i) -> named_struct('h', x.h, 'chars', x.chars, "
        "'before', if(i > 0, get(_l, i - 1).h, null), 'after', get(_l, i + 1).h))"
    )
    texts = rows.where("text is not null").select(F.col("_row").alias("row"), "doc_id", hashed.alias("_l"))
    lines = texts.select("row", "doc_id", F.posexplode(around).alias("i", "_x")).where("_x.h is not null")
    lines = lines.select("row", "doc_id", "i", F.lit(1).alias("k"), "_x.*")
    runs = texts.select("row", "doc_id", F.explode(_runs(F.col("_l.h"), F.col("_l.chars"))).alias("_x"))
    lines = stored(lines.unionByName(runs.select("row", "doc_id", "_x.*"), allowMissingColumns=True))

    # The earliest holder of every line or run that several documents have.
    in_doc = lines.groupBy("h", "row", "doc_id").agg(
        F.sort_array(F.collect_list("i")).alias("places"), F.min(F.struct("i", "before", "after")).alias("at")
    )
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "places", "at")
    holders = in_doc.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min(order).alias("f")).where("df > 1")
    holders = stored(
        holders.select(
            "h", "df", F.col("f.row").alias("partner"), F.col("f.at.i").alias("j"), (F.size("f.places") == 1).alias("once"),
            F.when(F.size("f.places") > 1, F.col("f.places")).alias("places"),
            F.col("f.at.before").alias("holder_before"), F.col("f.at.after").alias("holder_after"),
        )
    )
    shared = stored(lines.join(holders, "h").where("row <> partner").drop("h", "doc_id"))
    own = F.struct("i", "k", "chars", "before", "after", "partner", "j", "places", "once", "holder_before", "holder_after", "df")
    lists = shared.groupBy("row").agg(F.collect_list(own).alias("shared"))
    return stored(aligned(lists))


def drop_common_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with cut ``text``, ``n_lines`` (before), ``n_removed`` and ``removed`` places."""
    rows = numbered(docs.drop("n_lines", "n_removed", "removed"))
    return without_lines(rows, common_blocks(rows.select("_row", "doc_id", "text")), "n_lines")
