"""Names and field declarations: conversions, and rules that a registry must meet."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Field, Model


def to_snake(name: Column) -> Column:
    """PascalCase as snake_case; an acronym is one word."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def is_pascal(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Z][A-Za-z0-9]*\z"), F.lit(False))


def field_problems(f: Field, document: bool) -> list[str]:
    """What is wrong with a field's declaration."""
    tests = [
        (not re.fullmatch(r"[a-z][a-z0-9_]*", f.name), "the name isn't snake case"),
        (f.mandatory and f.na, "a mandatory field can't be not applicable"),
        (f.mandatory and f.default not in (None, "", ()), "a mandatory field has no default"),
        (f.least < 0 or f.least and f.kind != "text", "a least length is for text"),
        (f.kind == "enum" and not f.allowed, "an enumeration has no values"),
        (f.scored and len(f.description) < 10, "the description is too short"),
        (f.scored and not f.question.endswith("?"), "the question is none"),
        (document and not f.binding, "a document's field needs a binding"),
        (not document and bool(f.binding), "an entity's field has no binding"),
    ]
    return [f"{f.name}: {said}" for wrong, said in tests if wrong]


def model_problems(model: Model, document: bool) -> list[str]:
    names = [f.name for f in model.fields]
    return [f"{n}: declared twice" for n in sorted({n for n in names if names.count(n) > 1})] + [p for f in model.fields for p in field_problems(f, document)]
