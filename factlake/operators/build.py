"""Building documents: facts joined per application, projected to sections, with every unanswered field reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.registry import FACTS, MODELS, SHARED, SHARED_FACTS, Field, bindings, type_of
from . import validate


class BuildError(ValueError):
    """A document or fact that isn't registered."""


def answered(f: Field, own: Column) -> Column:
    """Whether a source field (of a fact that is there) has more than its default; mandatory and not applicable count as answered."""
    if f.mandatory:
        return F.lit(True)
    value = own["value"] if f.na else own
    if f.kind in ("texts", "items"):
        some = F.coalesce(F.size(value), F.lit(0)) > 0
    else:
        some = value.isNotNull() if f.default is None else F.coalesce(value != F.lit(f.default), F.lit(False))
    return some | own["na_reason"].isNotNull() if f.na else some


def default_of(f: Field) -> Column:
    if f.kind in ("texts", "items"):
        value = F.array().cast(type_of(f)["value"].dataType if f.na else type_of(f))
        return F.struct(value.alias("value"), F.lit(None).cast("string").alias("na_reason")) if f.na else value
    return F.lit(f.default if f.default != () else None).cast(type_of(f))


def fact_columns(facts: DataFrame, names: set[str]) -> DataFrame:
    """One row per application with a typed column per fact; Shared facts come to every application. Component facts take no part.

    facts: key, value. The Shared row is one row, whatever the number of applications.
    """
    parts = keys.segments(F.col("key"))
    two = facts.filter(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("app_id"), F.get(parts, F.lit(1)).alias("fact"), "value")
    pick = lambda n: F.max(F.when(F.col("fact") == n, F.col("value"))).alias(n)
    own, shared = sorted(names - SHARED_FACTS), sorted(names & SHARED_FACTS)
    apps = two.filter((F.col("app_id") != SHARED) & F.col("fact").isin(*own)).groupBy("app_id").agg(*map(pick, own))
    if shared:
        apps = apps.crossJoin(F.broadcast(two.filter((F.col("app_id") == SHARED) & F.col("fact").isin(*shared)).agg(*map(pick, shared))))
    present = lambda n: F.when(F.col(n).isNotNull(), validate.typed(MODELS[n], F.try_parse_json(n))).alias(n)
    return apps.select("app_id", *map(present, sorted(names)))


def build_documents(facts: DataFrame, doc_type: str) -> tuple[DataFrame, DataFrame]:
    """(bodies, failures) for all applications at once.

    bodies: app_id, key, body (typed), value (canonical JSON), missing (array of field, question, expected_source, in order).
    failures: app_id and the paths without which the first section with a mandatory field can't be made.
    """
    if f"{doc_type}Document" not in MODELS:
        raise BuildError(f"no document type {doc_type!r}")
    bound = bindings(doc_type)
    for path, fact, source, _ in bound:
        if fact not in FACTS or source not in {f.name for f in MODELS[fact].fields}:
            raise BuildError(f"{path} is bound to {fact}.{source}, which isn't registered")
    rows = fact_columns(facts, {fact for _, fact, _, _ in bound})
    got = {path: F.col(fact).isNotNull() & answered(MODELS[fact][source], F.col(fact)[source]) for path, fact, source, _ in bound}
    said = [F.when(~F.coalesce(got[path], F.lit(False)), F.struct(F.lit(path).alias("field"), F.lit(f.question).alias("question"), F.lit(f.binding).alias("expected_source"))) for path, _, _, f in bound]
    rows = rows.withColumn("missing", F.array_compact(F.array(*said)))
    mandatory = {fact for path, fact, _, f in bound if f.mandatory}
    whole = F.lit(True)
    for fact in sorted(mandatory):
        whole &= F.col(fact).isNotNull()
    sections = []
    for section in MODELS[f"{doc_type}Document"].fields:
        own = [(path, fact, source, f) for path, fact, source, f in bound if path.startswith(f"{section.name}.")]
        sections.append(F.struct(*[F.when(F.coalesce(got[path], F.lit(False)), F.col(fact)[source]).otherwise(default_of(f)).alias(f.name) for path, fact, source, f in own]).alias(section.name))
    bodies = rows.filter(whole).withColumn("body", F.struct(*sections))
    bodies = bodies.select("app_id", keys.output_key(F.col("app_id"), F.lit(doc_type)).alias("key"), "body", F.to_json(untyped(f"{doc_type}Document", F.col("body"))).alias("value"), "missing")
    failures = rows.filter(~whole).select("app_id", F.transform(F.filter("missing", lambda m: F.split(m["field"], r"\.")[0].isin(*sorted({p.split(".")[0] for p, fact, _, f in bound if fact in mandatory}))), lambda m: m["field"]).alias("unresolved"))
    return bodies, failures


def untyped(model: str, own: Column) -> Column:
    """A typed struct as the VARIANT that is stored: not applicable as {"reason": ...}."""
    members = []
    for f in MODELS[model].fields:
        x = own[f.name]
        if f.kind == "item":
            inner = untyped(f.item, x)
        elif f.kind == "items":
            inner = F.to_variant_object(F.transform(x, lambda i: untyped(f.item, i)))
        elif f.na:
            plain = F.parse_json(F.to_json(F.struct(x["value"].alias("v")), {"ignoreNullFields": "false"}))
            inner = F.when(x["na_reason"].isNotNull(), F.to_variant_object(F.struct(x["na_reason"].alias("reason")))).otherwise(F.try_variant_get(plain, "$.v", "variant"))
        else:
            inner = x
        members.append(inner.alias(f.name))
    return F.to_variant_object(F.struct(*members))


def missing_rows(bodies: DataFrame) -> DataFrame:
    """One row per unanswered field: app_id, ordinal, field, question, expected_source."""
    return bodies.select("app_id", F.posexplode("missing").alias("ordinal", "m")).select("app_id", "ordinal", "m.*")
