"""Row numbers that stay the same while a table is read several times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a unique number for each row, null and repeated ids included.

    Numbers follow from the partition and the place in it, so ``df`` must give the same
    partitions whenever it is read: a table, or a stored or checkpointed result.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def without_lines(rows: DataFrame, gone: DataFrame, counted: str) -> DataFrame:
    """Numbered ``rows`` with the lines at the places ``removed`` of ``gone (row, removed)`` cut
    from ``text``; adds ``counted`` (lines before), ``n_removed`` and ``removed``."""
    lines = F.split("text", "\n")
    rest = F.expr(r"array_join(filter(split(text, '\n'), (x, i) -> not array_contains(removed, i)), '\n')")
    # Merged always: the cuts grow with the texts, and a plan that broadcasts them while they are
    # few would turn over at some size.
    joined = rows.join(gone.withColumnRenamed("row", "_row").hint("merge"), "_row", "left")
    return joined.withColumns(
        {
            counted: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint"),
            "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("bigint"),
            "text": F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest),
        }
    ).drop("_row")
