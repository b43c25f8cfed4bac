"""Completeness: how many of an object's scored leaves are answered, compiled from the registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.registry import MODELS, Field, Model


def pair(answered: Column | int, total: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(answered).cast("long").alias("answered"), lit(total).cast("long").alias("total"))


def _added(pairs: list[Column]) -> Column:
    """The sum of pairs, folded so that each is computed once."""
    start = pair(0, 0)
    return F.aggregate(F.array(*pairs), start, lambda a, x: pair(a["answered"] + x["answered"], a["total"] + x["total"])) if pairs else start


def _nested(model: Model, own: Column) -> Column:
    """A nested object's counts; one answered leaf if nothing in it is scored."""
    return counts(model, own) if any(f.scored for f in model.fields) else pair(1, 1)


def _present(f: Field, own: Column) -> Column:
    if f.kind == "item":
        return _nested(MODELS[f.item], own)
    if f.kind == "items":
        summed = F.aggregate(F.transform(own, lambda x: _nested(MODELS[f.item], x)), pair(0, 0), lambda a, x: pair(a["answered"] + x["answered"], a["total"] + x["total"]))
        return F.when(F.size(own) > 0, summed).otherwise(pair(1, 1))
    return pair(1, 1)


def field_pair(f: Field, own: Column) -> Column:
    """A field's (answered, total): not applicable, mandatory, empty list, default and present, decided in this order."""
    value = own["value"] if f.na else own
    empty = F.coalesce(F.size(value), F.lit(0)) == 0 if f.kind in ("texts", "items") else value.isNull() if f.default is None else F.coalesce(value == F.lit(f.default), F.lit(False))
    out = _present(f, value) if f.mandatory else F.when(empty, pair(0, 1)).otherwise(_present(f, value))
    return F.when(own["na_reason"].isNotNull(), pair(1, 1)).otherwise(out) if f.na else out


def counts(model: Model, own: Column) -> Column:
    """(answered, total) over a typed struct's scored fields."""
    return _added([field_pair(f, own[f.name]) for f in model.fields if f.scored])


def percent(answered: Column, total: Column) -> Column:
    """100 for nothing to answer, else the share; divided first, as floating point has it."""
    return F.when(total == 0, F.lit(100.0)).otherwise(answered / total * 100)


def completeness(model: Model, own: Column) -> Column:
    return F.transform(F.array(counts(model, own)), lambda p: percent(p["answered"], p["total"]))[0]
