"""Validation of JSON payloads against registered models, as Column expressions over VARIANT.

``normal`` fills defaults and gives the canonical object, ``typed`` its typed struct, ``errors`` every violation in declaration
order, extra fields last. Nothing raises: a payload that is no JSON object yields one error at path ``payload``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.canonical import shown
from ..functions.registry import MODELS, NA, Field, Model, type_of

VARIANTS = "array<variant>"
ERROR = "struct<path:string,message:string,error_type:string,received:string,expected:string,field_description:string,question:string>"
SHOULD_BE = "Input should be "


def part(v: Column, name: str) -> Column:
    """A member as VARIANT: SQL null if absent, a null VARIANT if it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_null(v: Column) -> Column:
    return F.coalesce(F.is_variant_null(v), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("ARRAY"), F.lit(False))


def text_in(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def list_in(v: Column) -> Column:
    """The elements of a list as an array of VARIANT; empty for anything else."""
    return F.coalesce(F.when(is_list(v), v.cast(VARIANTS)), F.array().cast(VARIANTS))


def _default(f: Field) -> Column:
    return F.parse_json(F.lit("[]" if f.kind in ("texts", "items") else '""' if f.default == "" else "null"))


def normal(model: Model, v: Column) -> Column:
    """A valid object with absent fields filled in, as VARIANT (its JSON has sorted keys)."""
    members = []
    for f in model.fields:
        own = part(v, f.name)
        if f.kind == "items":
            inner = F.to_variant_object(F.transform(list_in(own), lambda x: normal(MODELS[f.item], x)))
        elif f.kind == "item":
            inner = F.when(is_object(own), normal(MODELS[f.item], own)).otherwise(F.coalesce(own, _default(f)))
        else:
            inner = F.coalesce(own, _default(f))
        members.append(inner.alias(f.name))
    return F.to_variant_object(F.struct(*members))


def typed(model: Model, v: Column) -> Column:
    """A normal object as its typed struct."""
    members = []
    for f in model.fields:
        own = part(v, f.name)
        if f.kind == "items":
            inner = F.transform(list_in(own), lambda x: typed(MODELS[f.item], x))
        elif f.kind == "item":
            inner = F.when(is_object(own), typed(MODELS[f.item], own))
        elif f.kind == "texts":
            inner = F.transform(list_in(own), text_in)
        elif f.kind in SCALARS:
            inner = F.try_variant_get(own, "$", type_of(f).simpleString())
        else:
            inner = text_in(own)
        if f.na:
            reason = F.when(is_object(own), text_in(part(own, "reason")))
            value = F.when(is_list(own), inner) if f.kind == "texts" else F.when(is_text(own), inner)
            inner = F.when(value.isNotNull() | reason.isNotNull(), F.struct(value.alias("value"), reason.alias("na_reason")))
            inner = inner.cast(type_of(f)) if f.kind == "texts" else inner.cast(NA)
        members.append(inner.alias(f.name))
    return F.struct(*members)


def _error(path: Column, message: str | Column, kind: str, received: Column | None, expected: str | Column | None, f: Field | None, description: str = "", question: Column | str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    said = message if isinstance(message, str) else ""
    if expected is None and said.startswith(SHOULD_BE):
        expected = said.removeprefix(SHOULD_BE)
    columns = [path, lit(message), lit(kind), received if received is not None else F.lit(None).cast("string"), lit(expected), lit(f.description if f else description), lit(f.question if f else question)]
    return F.struct(*[c.cast("string").alias(n) for c, n in zip(columns, ("path", "message", "error_type", "received", "expected", "field_description", "question"), strict=True)])


def _dotted(path: Column | None, name: str | Column) -> Column:
    own = name if isinstance(name, Column) else F.lit(name)
    return own if path is None else F.concat_ws(".", path, own)


def _only(test: Column, error: Column) -> Column:
    """An array with the error if the test holds, else none."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(error)).otherwise(F.array().cast(f"array<{ERROR}>"))


def _text_errors(f: Field, v: Column, path: Column) -> Column:
    wrong = ~is_text(v)
    found = _only(wrong, _error(path, "Input should be a valid string", "string_type", shown(v), None, f))
    if f.least:
        short = f"String should have at least {f.least} character" + "s" * (f.least > 1)
        found = F.concat(found, _only(~wrong & (F.char_length(text_in(v)) < f.least), _error(path, short, "string_too_short", shown(v), None, f)))
    return found


#: Of a scalar kind other than text: VARIANT's kinds that it takes, what it should be, and the error.
SCALARS = {"integer": ("BIGINT", "a valid integer", "int_type"), "number": ("BIGINT|DOUBLE|FLOAT|DECIMAL.*", "a valid number", "float_type"), "flag": ("BOOLEAN", "a valid boolean", "bool_type")}


def _scalar_errors(f: Field, v: Column, path: Column) -> Column:
    takes, wanted, kind = SCALARS[f.kind]
    return _only(~F.coalesce(_kind(v).rlike(f"^(?:{takes})$"), F.lit(False)), _error(path, SHOULD_BE + wanted, kind, shown(v), wanted, f))


def _list_errors(f: Field, v: Column, path: Column) -> Column:
    found = _only(~is_list(v), _error(path, "Input should be a valid list", "list_type", shown(v), None, f))
    each = (lambda x, i: _text_errors(_plain(f), x, _dotted(path, i.cast("string")))) if f.kind == "texts" else (lambda x, i: errors(MODELS[f.item], x, _dotted(path, i.cast("string")), f))
    return F.concat(found, F.flatten(F.transform(list_in(v), each)))


def _plain(f: Field) -> Field:
    return Field(f.name, "text", owner=f.owner)


def _value_errors(f: Field, v: Column, path: Column) -> Column:
    """Violations of a field that is there."""
    if f.kind == "enum":
        names = [f"'{a}'" for a in f.allowed]
        wanted = names[0] if len(names) == 1 else f"{', '.join(names[:-1])} or {names[-1]}"
        found = _only(~(is_text(v) & F.coalesce(text_in(v).isin(*f.allowed), F.lit(False))), _error(path, SHOULD_BE + wanted, "enum", shown(v), wanted, f))
    elif f.kind == "item":
        found = errors(MODELS[f.item], v, path, f)
    else:
        own = _list_errors if f.kind in ("texts", "items") else _scalar_errors if f.kind in SCALARS else _text_errors
        if f.na:
            # Both members of the union complain, each under its own tag, if neither takes the value.
            first = own(f, v, _dotted(path, "list[str]" if f.kind == "texts" else "str"))
            second = errors(MODELS["NotApplicable"], v, _dotted(path, "NotApplicable"), f)
            found = F.when((F.size(first) == 0) | (F.size(second) == 0), F.array().cast(f"array<{ERROR}>")).otherwise(F.concat(first, second))
        else:
            found = own(f, v, path)
    return F.when(_is_null(v), F.array().cast(f"array<{ERROR}>")).otherwise(found) if f.nullable else found


def errors(model: Model, v: Column, path: Column | None = None, owner: Field | None = None) -> Column:
    """All violations of an object, as an array of error structs."""
    at = F.lit("payload") if path is None else path
    what = f"Input should be a valid dictionary or instance of {model.name}"
    found = [_only(~is_object(v), _error(at, what, "model_type", shown(v), None, owner, f"An object of kind {model.name}.", f"Which fields does the {model.name} have?"))]
    inner = []
    for f in model.fields:
        own, here = part(v, f.name), _dotted(path, f.name)
        absent = _only(own.isNull(), _error(here, "Field required", "missing", None, "a value for this field", f)) if f.mandatory else F.array().cast(f"array<{ERROR}>")
        inner.append(F.when(own.isNull(), absent).otherwise(_value_errors(f, own, here)))
    names = ", ".join(f.name for f in model.fields)
    extra = F.array_except(F.map_keys(v.cast("map<string,variant>")), F.array(*[F.lit(f.name) for f in model.fields]))
    question = lambda k: F.concat(F.lit("'"), k, F.lit(f"' is no field of {model.name}. To which of its fields ({names}) does it belong?"))
    inner.append(F.transform(extra, lambda k: _error(_dotted(path, k), "Extra inputs are not permitted", "extra_forbidden", shown(F.element_at(v.cast("map<string,variant>"), k)), "no such field; remove it", None, f"An object of kind {model.name}.", question(k))))
    found.append(F.when(is_object(v), F.concat(*inner)).otherwise(F.array().cast(f"array<{ERROR}>")))
    return F.concat(*found)


def payload_errors(model: Model, payload: Column) -> Column:
    """Violations of JSON text; text that is no JSON counts as a payload that is no object."""
    return errors(model, F.coalesce(F.try_parse_json(payload), F.parse_json(F.lit("null"))))
