"""Expressions over figure structs, series, tables and statistics lists.

A figure ``struct`` arrives as JSON text of an open shape. The parts the rules look at are
read with fixed schemas; leaf values that may be number or text stay VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHART = (
    "struct<chart_type:string,insight:string,series:array<struct<name:string,"
    "points:array<struct<x:variant,y:variant,label:variant,value:variant>>>>>"
)
DIAGRAM = (
    "struct<diagram_type:string,insight:string,nodes:array<struct<id:string,label:string>>,"
    "edges:array<struct<from:string,to:string>>>"
)
TABLE = "struct<headers:array<string>,rows:array<array<string>>>"

# Words by which an insight claims that a series does not vary.
FLAT_WORDS = "uniform|constant|균등|flat|동일"


def _wrapped(text: Column) -> Column:
    """The text followed by ``true`` in one array.

    The parser ignores what follows the first value of a text, so a text is one JSON value and
    nothing else exactly when this array has two elements.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(",true]")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, for parses used more than once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, else null."""
    items = F.try_variant_get(_wrapped(text), "$", "array<variant>")
    return once(items, lambda found: F.when(F.size(found) == 2, found[0]))


def is_json(text: Column) -> Column:
    """Is the text one JSON value and nothing else? Null text is not."""

    def element(doc: Column, at: int) -> Column:
        return F.try_variant_get(doc, f"$[{at}]", "variant")

    return once(_wrapped(text), lambda doc: element(doc, 1).isNotNull() & element(doc, 2).isNull())


def as_number(value: Column) -> Column:
    """VARIANT to double; numeric text counts, everything else is null."""
    return F.try_variant_get(value, "$", "double")


def as_strict_number(value: Column) -> Column:
    """VARIANT to double; only JSON numbers count."""
    return F.when(
        F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), as_number(value)
    )


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def normal_series(series: Column) -> Column:
    """``array<struct<name, xs, ys>>``: ``x`` else ``label``, ``y`` else ``value``.

    Points without a number are dropped, then series without points.
    """

    def one(entry: Column) -> Column:
        points = F.transform(
            entry["points"],
            lambda p: F.struct(
                as_text(F.coalesce(p["x"], p["label"])).alias("x"),
                as_number(F.coalesce(p["y"], p["value"])).alias("y"),
            ),
        )
        kept = F.filter(points, lambda p: p["y"].isNotNull())
        return F.struct(
            F.coalesce(entry["name"], F.lit("")).alias("name"),
            F.transform(kept, lambda p: p["x"]).alias("xs"),
            F.transform(kept, lambda p: p["y"]).alias("ys"),
        )

    return F.filter(F.transform(series, one), lambda s: F.size(s["ys"]) > 0)


def chart_values(chart: Column) -> Column:
    """All numeric y values of a chart, in order."""
    per_series = F.transform(
        chart["series"],
        lambda s: F.transform(s["points"], lambda p: as_strict_number(F.coalesce(p["y"], p["value"]))),
    )
    known = F.filter(per_series, lambda ys: ys.isNotNull())
    return F.filter(F.flatten(known), lambda y: y.isNotNull())


def chart_contradicts_insight(chart: Column) -> Column:
    """The insight says flat, the values vary."""
    claims = F.lower(F.coalesce(chart["insight"], F.lit(""))).rlike(FLAT_WORDS)
    return F.coalesce(claims & (F.size(F.array_distinct(chart_values(chart))) > 1), F.lit(False))


def diagram_is_consistent(diagram: Column) -> Column:
    """Nodes with ids exist and every edge joins two of them; other structs pass."""
    ids = F.filter(F.transform(diagram["nodes"], lambda n: n["id"]), lambda i: i.isNotNull())
    edges = F.coalesce(diagram["edges"], F.array().cast("array<struct<from:string,to:string>>"))
    ends = F.flatten(F.transform(edges, lambda e: F.array(e["from"], e["to"])))
    # Ends that are no node, a missing one among them.
    edges_ok = F.size(F.array_except(ends, ids)) == 0
    return F.when(diagram["diagram_type"].isNull(), F.lit(True)).otherwise(
        (F.coalesce(F.size(ids), F.lit(0)) > 0) & F.coalesce(edges_ok, F.lit(False))
    )


def chart_is_informative(chart_type: Column, ys: Column) -> Column:
    """Bars always pass; lines and scatters need two points that differ."""
    return (chart_type == "bar") | ((F.size(ys) >= 2) & (F.array_max(ys) != F.array_min(ys)))


def diagram_is_dense(nodes: Column, least: int = 3) -> Column:
    return F.coalesce(F.size(F.filter(nodes, lambda n: n["id"].isNotNull())), F.lit(0)) >= least


def table_is_usable(headers: Column, rows: Column) -> Column:
    return (F.coalesce(F.size(headers), F.lit(0)) > 0) & (F.coalesce(F.size(rows), F.lit(0)) > 0)


def bar_spread(n_series: Column, ys: Column, limit: float = 12.0) -> Column:
    """One series with two or more positive values whose largest is ``limit`` times the smallest."""
    positive = F.filter(ys, lambda y: y > 0)
    return F.coalesce(
        (n_series == 1)
        & (F.size(positive) >= 2)
        & (F.array_max(positive) / F.array_min(positive) >= limit),
        F.lit(False),
    )


def fit_row(row: Column, width: Column) -> Column:
    """Cut or pad a table row to the header width."""
    cut = F.slice(row, F.lit(1), width)
    return F.concat(cut, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cut))))
