"""Order-dependent building blocks that never put a whole group into one task.

A window partitioned by recording is wrong at scale: one recording may hold a third of all
rows. Everything here works in two levels instead. A *slot* is a column that does not
decrease along the wanted order (a time bucket, or a row position divided by a constant).
The expensive work is partitioned by ``(group, slot)``; only one summary row per slot is then
scanned along the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.session import stored

# One hour of a recording split in twelve. Narrow on purpose: a sparse recording has few rows
# whatever the width, a dense one is cut into many tasks.
TIME_SLOT_SEC = 300.0
# For orders that are already dense integers.
ORD_SLOT_ROWS = 1 << 20
# Rows up to which a group may be numbered in one task.
SMALL_GROUP_ROWS = 1 << 16


def time_slot(seconds: Column | str, width: float = TIME_SLOT_SEC) -> Column:
    """Slot number of a point in time."""
    return F.floor(_col(seconds) / F.lit(float(width)))


def ord_slot(order: Column | str, rows: int = ORD_SLOT_ROWS) -> Column:
    """Slot number of an integer order key."""
    return F.floor(_col(order) / F.lit(rows))


def slots_covered(lo: Column | str, hi: Column | str, width: float = TIME_SLOT_SEC) -> Column:
    """Array of the slots an interval touches; empty when the interval is reversed or null."""
    first, last = time_slot(lo, width), time_slot(hi, width)
    return F.when(_col(hi) >= _col(lo), F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>")
    )


def position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    slot: Column,
    pos: str = "pos",
    size: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group (and the group size, if named).

    Equal to ``row_number() over (partition by group order by order) - 1``. ``slot`` must not
    decrease along ``order``; rows with a null order value are in a null slot, which comes first as
    nulls do. Null group values are one group.
    """
    keys = list(group)
    slotted = df.withColumn("_slot", slot)
    local = slotted.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order))
    )
    along = Window.partitionBy(*keys).orderBy("_slot")
    base = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
    )
    if size:
        base = base.withColumn(size, F.sum("_rows").over(Window.partitionBy(*keys)))
    return (
        _with_summary(local, base.drop("_rows"), [*keys, "_slot"])
        .withColumn(pos, (F.col("_before") + F.col("_local") - 1).cast("bigint"))
        .drop("_local", "_before", "_slot")
    )


def previous(
    df: DataFrame, group: Sequence[str], order: Sequence[str], slot: Column, values: dict[str, str]
) -> DataFrame:
    """Add, for each ``{new: source}``, the value of the previous row of the group.

    Equal to ``lag(source) over (partition by group order by order)``.
    """
    keys = list(group)
    packed = F.struct(*[F.col(source).alias(new) for new, source in values.items()])
    slotted = df.withColumn("_slot", slot).withColumn("_packed", packed)
    within = Window.partitionBy(*keys, "_slot").orderBy(*order)
    local = slotted.withColumn("_lag", F.lag("_packed").over(within))
    tails = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.max_by("_packed", F.struct(*order)).alias("_tail"))
        .withColumn("_carried", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slot")))
    )
    joined = _with_summary(local, tails.drop("_tail"), [*keys, "_slot"])
    found = F.coalesce("_lag", "_carried")
    return joined.withColumns({new: found[new] for new in values}).drop(
        "_slot", "_packed", "_lag", "_carried"
    )


def position_in_groups(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], slot: Column, pos: str = "pos", small_rows: int = SMALL_GROUP_ROWS
) -> DataFrame:
    """The same position where most groups are small: those of up to ``small_rows`` rows are one window
    each, only larger ones are cut in slots. Counts the groups first, so ``df`` should be cheap to read.
    """
    keys = list(group)
    large = df.groupBy(*keys).count().where(F.col("count") > small_rows).select(*[F.col(c).alias(f"_of_{c}") for c in keys])
    large = stored(large)
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if large.isEmpty():
        return df.withColumn(pos, (within - 1).cast("bigint"))
    is_large = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    small = df.join(large, is_large, "left_anti").withColumn(pos, (within - 1).cast("bigint"))
    return small.unionByName(position(df.join(large, is_large, "left_semi"), keys, order, slot, pos))


def neighbours(
    df: DataFrame, group: Sequence[str], order: Sequence[str], slot: Column, value: str
) -> DataFrame:
    """Add ``_before`` and ``_after``: the nearest non-null ``value`` at or before, and at or
    after, each row of the group. ``order`` names plain columns.
    """
    keys = list(group)
    up = [F.col(c).asc() for c in order]
    down = [F.col(c).desc() for c in order]
    to_here = (Window.unboundedPreceding, Window.currentRow)
    earlier = (Window.unboundedPreceding, -1)
    slotted = df.withColumn("_slot", slot)
    inside = Window.partitionBy(*keys, "_slot")
    local = slotted.withColumns(
        {
            "_up": F.last(value, ignorenulls=True).over(inside.orderBy(*up).rowsBetween(*to_here)),
            "_down": F.last(value, ignorenulls=True).over(inside.orderBy(*down).rowsBetween(*to_here)),
        }
    )
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    along = Window.partitionBy(*keys)
    edges = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.max_by(value, known).alias("_last"), F.min_by(value, known).alias("_first"))
        .select(
            *keys,
            "_slot",
            F.last("_last", ignorenulls=True).over(along.orderBy(F.asc("_slot")).rowsBetween(*earlier)).alias("_below"),
            F.last("_first", ignorenulls=True).over(along.orderBy(F.desc("_slot")).rowsBetween(*earlier)).alias("_above"),
        )
    )
    return _with_summary(local, edges, [*keys, "_slot"]).select(
        *df.columns,
        F.coalesce("_up", "_below").alias("_before"),
        F.coalesce("_down", "_above").alias("_after"),
    )


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group: one narrow, map-side combined aggregation."""
    return df.groupBy(*group).count().agg(F.max("count").alias("n")).first()["n"] or 0


def _with_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their slot's ``summary``; null keys match null keys."""
    there = summary.select(*[F.col(c).alias(f"_of_{c}" if c in keys else c) for c in summary.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return rows.join(there, reduce(and_, same)).drop(*[f"_of_{c}" for c in keys])


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
