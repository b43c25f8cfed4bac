"""Predicates and parts of dotted keys as Column expressions. A null key never matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import SHARED, Saver


def segments(key: Column) -> Column:
    return F.split(key, r"\.", -1)


def matches(pattern: str, key: Column) -> Column:
    """Whether a key has the pattern's segments; ``{app}`` is any but Shared, other placeholders any non-empty segment."""
    parts, want = segments(key), pattern.split(".")
    out = F.size(parts) == len(want)
    for i, p in enumerate(want):
        own = F.get(parts, F.lit(i))
        test = (own != "") if p.startswith("{") else (own == p)
        out &= test & (own != SHARED) if p == "{app}" else test
    return F.coalesce(out, F.lit(False))


def matches_any(patterns: tuple[str, ...], key: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= matches(p, key)
    return out


def app_id(key: Column) -> Column:
    """The first segment; null for Shared."""
    return F.nullif(F.get(segments(key), F.lit(0)), F.lit(SHARED))


def app_agrees(key: Column, given: Column) -> Column:
    return given.isNull() | given.eqNullSafe(app_id(key))


def fact_key(app: Column, fact: str, shared: bool) -> Column:
    return F.lit(f"{SHARED}.{fact}") if shared else F.concat_ws(".", app, F.lit(fact))


def output_key(app: Column, doc_type: Column, part: str | None = None) -> Column:
    return F.concat_ws(".", app, F.lit("Outputs"), doc_type, *([F.lit(part)] if part else []))


def table_of(savers: dict[str, Saver], key: Column) -> Column:
    """The table that a key's saver writes to; null for a key that no saver takes."""
    out = F.lit(None).cast("string")
    for s in savers.values():
        out = F.when(matches_any(s.patterns, key), F.lit(s.table)).otherwise(out)
    return out


def sample_key(pattern: str) -> str:
    """A key of the pattern, for tests and messages."""
    return pattern.replace("{app}", "TestApp").replace("{component}", "testcomponent").replace("{doctype}", "TESTDOC")


def pattern_problems(kind: str, pattern: str) -> list[str]:
    """What is wrong with a saver's key pattern; kind: entity or document."""
    first, *rest = pattern.split(".")
    out = []
    if first not in ("{app}", SHARED):
        out.append(f"{pattern}: must start with {{app}} or {SHARED}")
    if not rest or "" in rest:
        out.append(f"{pattern}: has an empty segment or only one")
    if kind == "document" and (len(rest) < 2 or rest[0] != "Outputs"):
        out.append(f"{pattern}: documents are kept under .Outputs.")
    return out
