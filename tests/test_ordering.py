"""Two-level ordering equals a plain window, whatever the slots."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuesheet.ordering import neighbours, position, position_in_groups, previous, slots_covered, time_slot


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 7}", round(draw.uniform(0, 900), 1), i, draw.choice([None, i])) for i in range(600)]
    return spark.createDataFrame(data, "g string, t double, ord long, v long").cache()


@pytest.mark.parametrize("width", [1.0, 50.0, 10000.0])
def test_position(rows, width):
    order = [F.col("t"), F.col("ord")]
    got = position(rows, ["g"], order, time_slot("t", width), "pos", "n")
    w = Window.partitionBy("g")
    want = rows.withColumn("pos", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    assert sorted(map(tuple, got.select("ord", "pos", "n").collect())) == sorted(map(tuple, want.select("ord", "pos", "n").collect()))


@pytest.mark.parametrize("small", [0, 60, 10000])
def test_position_in_groups(rows, small):
    """Only groups of more than ``small`` rows are cut in slots; the null group counts as one."""
    order, some = [F.col("t"), F.col("ord")], rows.withColumn("g", F.nullif("g", F.lit("g2")))
    got = position_in_groups(some, ["g"], order, time_slot("t", 50.0), "pos", small)
    want = some.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1)
    assert sorted(map(tuple, got.select("ord", "pos").collect())) == sorted(map(tuple, want.select("ord", "pos").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("_slot" in plan) == (small < 10000)


@pytest.mark.parametrize("width", [1.0, 50.0, 10000.0])
def test_previous(rows, width):
    got = previous(rows, ["g"], ["t", "ord"], time_slot("t", width), {"p": "ord"})
    want = rows.withColumn("p", F.lag("ord").over(Window.partitionBy("g").orderBy("t", "ord")))
    assert {(r.ord, r.p) for r in got.collect()} == {(r.ord, r.p) for r in want.collect()}


@pytest.mark.parametrize("width", [1.0, 50.0, 10000.0])
def test_neighbours(rows, width):
    got = neighbours(rows, ["g"], ["t", "ord"], time_slot("t", width), "v")
    w = Window.partitionBy("g")
    want = rows.withColumns(
        {
            "_before": F.last("v", True).over(w.orderBy("t", "ord").rowsBetween(Window.unboundedPreceding, 0)),
            "_after": F.last("v", True).over(w.orderBy(F.desc("t"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    pick = lambda df: {(r.ord, r._before, r._after) for r in df.collect()}
    assert pick(got) == pick(want)


def test_slots_covered(spark):
    got = spark.sql("SELECT 299.0D AS a, 600.0D AS b UNION ALL SELECT 5.0D, 4.0D").select(slots_covered("a", "b").alias("s"))
    assert [r.s for r in got.collect()] == [[0, 1, 2], []]


def test_hot_group_is_split(rows):
    """No window over the rows themselves is partitioned by the group alone."""
    plan = position(rows, ["g"], [F.col("t")], time_slot("t", 50.0))._jdf.queryExecution().optimizedPlan().toString()
    row_window = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert row_window and all("_slot" in line for line in row_window)


def test_rows_without_order_value_or_group_stay(spark):
    data = [("a", 0.0, 1, 5), ("a", None, 2, None), ("a", 9.0, 3, 7), (None, None, 4, 1), (None, 2.0, 5, 2), ("a", None, 6, 8)]
    rows = spark.createDataFrame(data, "g string, t double, ord long, v long")
    w = Window.partitionBy("g").orderBy("t", "ord")
    slot = time_slot("t", 5.0)
    got = {r.ord: r.pos for r in position(rows, ["g"], [F.col("t"), F.col("ord")], slot).collect()}
    assert got == {r.ord: r.p - 1 for r in rows.withColumn("p", F.row_number().over(w)).collect()}
    got = {r.ord: r.p for r in previous(rows, ["g"], ["t", "ord"], slot, {"p": "ord"}).collect()}
    assert got == {r.ord: r.p for r in rows.withColumn("p", F.lag("ord").over(w)).collect()}
    got = {r.ord: r._before for r in neighbours(rows, ["g"], ["t", "ord"], slot, "v").collect()}
    before = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    assert got == {r.ord: r.p for r in rows.withColumn("p", before).collect()}
