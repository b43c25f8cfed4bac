"""Rendering stored documents as Markdown: expressions of line arrays, compiled from the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.registry import ACRONYMS, DOCUMENTS, MODELS, Field, Model, title
from . import validate

NOT_PROVIDED = "_Not provided._"


class RenderError(ValueError):
    """A document type that isn't registered."""


def title_of(name: Column) -> Column:
    """A field name as a heading, for names in data."""
    known = F.create_map(*[F.lit(x) for pair in ACRONYMS.items() for x in pair])
    word = lambda w: F.coalesce(F.try_element_at(known, w), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.array_join(F.transform(F.split(name, "_", -1), word), " ")


def scalar(own: Column, na_reason: Column | None = None) -> Column:
    out = F.coalesce(F.nullif(own, F.lit("")), F.lit(NOT_PROVIDED))
    return out if na_reason is None else F.when(na_reason.isNotNull(), F.concat(F.lit("_N/A — "), na_reason, F.lit("_"))).otherwise(out)


def list_lines(values: Column, render_as: str = "list", indent: str = "") -> Column:
    if render_as == "numbered":
        return F.transform(values, lambda x, i: F.concat(F.lit(indent), (i + 1).cast("string"), F.lit(". "), x))
    return F.transform(values, lambda x: F.concat(F.lit(f"{indent}- "), x))


def cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _shown(f: Field, own: Column) -> Column:
    """A field that isn't a list of items, as one text; a list is joined."""
    value, reason = (own["value"], own["na_reason"]) if f.na else (own, None)
    return scalar(F.array_join(value, ", ") if f.kind == "texts" else value, reason)


def item_lines(model: Model, item: Column) -> Column:
    parts = []
    for f in model.fields:
        own, label = item[f.name], f"  - **{f.label}:**"
        if f.kind == "texts":
            full = F.concat(F.array(F.lit(label)), list_lines(own, f.render_as, "    "))
            parts.append(F.when(F.size(own) > 0, full).otherwise(F.array(F.lit(f"{label} {NOT_PROVIDED}"))))
        else:
            parts.append(F.array(F.concat(F.lit(f"{label} "), _shown(f, own))))
    return F.concat(*parts)


def item_table(model: Model, items: Column) -> Column:
    head = [f"| {' | '.join(f.label for f in model.fields)} |", "|" + "---|" * len(model.fields)]
    row = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(_shown(f, x[f.name])) for f in model.fields]), F.lit(" |"))
    return F.concat(F.array(*map(F.lit, head)), F.transform(items, row), F.array(F.lit("")))


def field_lines(model: Model, own: Column, level: int = 2) -> Column:
    parts = []
    for f in model.fields:
        x, label = own[f.name], f"**{f.label}:**"
        if f.kind == "item":
            parts += [F.array(F.lit(f"{'#' * level} {f.label}"), F.lit("")), field_lines(MODELS[f.item], x, level + 1), F.array(F.lit(""))]
        elif f.kind == "items":
            inner = MODELS[f.item]
            if f.render_as == "table":
                full = F.concat(F.array(F.lit(label), F.lit("")), item_table(inner, x))
            else:
                numbered = F.flatten(F.transform(x, lambda i, n: F.concat(F.array(F.concat((n + 1).cast("string"), F.lit("."))), item_lines(inner, i))))
                full = F.concat(F.array(F.lit(label)), numbered, F.array(F.lit("")))
            parts.append(F.when(F.size(x) > 0, full).otherwise(F.array(F.lit(f"{label} {NOT_PROVIDED}"), F.lit(""))))
        elif f.kind == "texts":
            value = x["value"] if f.na else x
            full = F.concat(F.array(F.lit(label)), list_lines(value, f.render_as), F.array(F.lit("")))
            none = F.array(F.concat(F.lit(f"{label} "), scalar(F.lit(None).cast("string"), x["na_reason"]) if f.na else F.lit(NOT_PROVIDED)), F.lit(""))
            parts.append(F.when(F.coalesce(F.size(value), F.lit(0)) > 0, full).otherwise(none))
        else:
            parts.append(F.array(F.concat(F.lit(f"{label} "), _shown(f, x)), F.lit("")))
    return F.concat(*parts)


def body(model: Model, own: Column) -> Column:
    return F.regexp_replace(F.array_join(field_lines(model, own), "\n"), r"\n+\z", "")


def control_block(c: Column) -> Column:
    line = lambda label, text: F.concat(F.lit(f"- **{label}:** "), text)
    approvers = F.when(F.size(c["approvers"]) > 0, F.array_join(c["approvers"], ", ")).otherwise(F.lit(NOT_PROVIDED))
    rows = [("Document ID", c["document_id"]), ("Version", scalar(c["document_version"])), ("Status", scalar(c["status"])), ("Owner", scalar(c["owner"])), ("Approvers", approvers), ("Created", scalar(c["created_date"])), ("Last Updated", scalar(c["last_updated_date"]))]
    return F.concat_ws("\n", F.concat(F.lit("# "), c["title"]), F.lit(""), *[line(*r) for r in rows])


def history_block(h: Column) -> Column:
    author = lambda r: F.coalesce(F.nullif(r["author"], F.lit("")), F.lit("-"))
    rows = F.transform(h["revisions"], lambda r: F.concat(F.lit("| "), r["version"], F.lit(" | "), r["date"], F.lit(" | "), author(r), F.lit(" | "), r["summary"], F.lit(" |")))
    table = F.array_join(F.concat(F.array(F.lit("| Version | Date | Author | Summary |"), F.lit("|---|---|---|---|")), rows), "\n")
    notes = F.when(F.coalesce(h["notes"], F.lit("")) != "", F.concat(F.lit("\n\n"), h["notes"])).otherwise("")
    return F.concat(F.lit("## Revision History\n\n"), F.when(F.size(h["revisions"]) > 0, table).otherwise(F.lit(NOT_PROVIDED)), notes)


def render_markdown(outputs: DataFrame, doc_type: str) -> tuple[DataFrame, DataFrame]:
    """(markdown, absent) from stored outputs(key, value).

    markdown: app_id, doc_type, markdown. absent: app_id and the first missing key of control, history and body, in this order.
    """
    if doc_type not in DOCUMENTS:
        raise RenderError(f"no document type {doc_type!r}; there are {', '.join(DOCUMENTS)}")
    parts = keys.segments(F.col("key"))
    s = [F.get(parts, F.lit(i)) for i in range(4)]
    mine = outputs.filter((s[1] == "Outputs") & (s[2] == doc_type)).withColumn("app_id", s[0])
    kind = F.when(F.size(parts) == 3, "body").when((F.size(parts) == 4) & (s[3] == "DocumentControl"), "control").when((F.size(parts) == 4) & (s[3] == "RevisionHistory"), "history")
    mine = mine.withColumn("kind", kind)
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    wide = mine.groupBy("app_id").agg(pick("control"), pick("history"), pick("body"))
    read = lambda m, c: validate.typed(MODELS[m], F.try_parse_json(c))
    rows = wide.filter("control is not null and history is not null and body is not null")
    rows = rows.select("app_id", read("DocumentControl", "control").alias("c"), read("RevisionHistory", "history").alias("h"), read(f"{doc_type}Document", "body").alias("b"))
    text = F.concat_ws("\n\n", control_block(F.col("c")), history_block(F.col("h")), body(MODELS[f"{doc_type}Document"], F.col("b")))
    key = lambda part: keys.output_key(F.col("app_id"), F.lit(doc_type), part)
    first = F.when(F.col("control").isNull(), key("DocumentControl")).when(F.col("history").isNull(), key("RevisionHistory")).otherwise(key(None))
    absent = wide.filter("control is null or history is null or body is null").select("app_id", first.alias("missing_key"))
    return rows.select("app_id", F.lit(doc_type).alias("doc_type"), F.concat(text, F.lit("\n")).alias("markdown")), absent


__all__ = ["RenderError", "body", "cell", "control_block", "field_lines", "history_block", "item_lines", "item_table", "list_lines", "render_markdown", "scalar", "title", "title_of"]
