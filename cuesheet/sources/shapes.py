"""Shape of nested documents: which consumed field is the first that is missing or of a wrong kind.

A shape names only the fields that are consumed; others pass. It is checked on the parsed document
(a VARIANT) by one expression, so documents are neither flattened nor read in Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


@dataclass(frozen=True)
class Shape:
    """One value: its kinds, what else must hold of it, and the shapes inside it."""

    kinds: tuple[str, ...]
    required: bool = True  # may not be absent
    nullable: bool = False
    test: Callable[[Column], Column] | None = None
    fields: dict[str, "Shape"] = field(default_factory=dict)
    items: "Shape | None" = None


def text(test: Callable[[Column], Column] | None = None, **rules: bool) -> Shape:
    return Shape(("STRING",), test=None if test is None else lambda v: test(v.try_cast("string")), **rules)


def number(**rules: bool) -> Shape:
    return Shape(NUMBERS, **rules)


def flag(value: bool | None = None, **rules: bool) -> Shape:
    return Shape(("BOOLEAN",), test=None if value is None else lambda v: v.try_cast("boolean") == value, **rules)


def record(fields: dict[str, Shape], **rules: bool) -> Shape:
    return Shape(("OBJECT",), fields=fields, **rules)


def listed(items: Shape, **rules: bool) -> Shape:
    return Shape(("ARRAY",), items=items, **rules)


def first_bad(value: Column, shape: Shape, path: Column | str = "$") -> Column:
    """Path of the first field, in the order of the shape, that does not fit; null if all do."""
    path = F.lit(path) if isinstance(path, str) else path
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    wrong = ~kind.isin(*shape.kinds)
    if shape.test is not None:
        wrong = wrong | ~F.coalesce(shape.test(value), F.lit(False))
    inner = F.lit(None).cast("string")
    if shape.fields:
        inner = F.coalesce(
            *[first_bad(F.try_variant_get(value, f"$.{n}", "variant"), s, F.concat(path, F.lit(f".{n}"))) for n, s in shape.fields.items()]
        )
    elif shape.items is not None:
        items = F.try_variant_get(value, "$", "array<variant>")
        found = F.transform(items, lambda v, i: first_bad(v, shape.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        inner = F.get(F.filter(found, lambda p: p.isNotNull()), F.lit(0))
    return (
        F.when(value.isNull(), path if shape.required else F.lit(None))
        .when(F.is_variant_null(value), F.lit(None) if shape.nullable else path)
        .when(wrong, path)
        .otherwise(inner)
    )
