"""The registry: every model's fields, in order, with what saving, scoring, building and rendering need to know of them.

Everything here is plain data on the driver; other modules compile it into Column expressions. Field names, kinds, defaults and
compositions are fixed by the data that users have; labels, descriptions and questions are derived by rule.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Words of field names that aren't title-cased.
ACRONYMS = {"kpi": "KPI", "kpis": "KPIs", "id": "ID", "slo": "SLO", "slos": "SLOs", "sop": "SOP", "smtd": "SMTD", "srs": "SRS", "ci": "CI", "cd": "CD", "rpo": "RPO", "rto": "RTO", "url": "URL"}
RENDERINGS = ("list", "table", "numbered")
SHARED = "Shared"

# Fields in order. A name alone is text, empty by default. Marks after the name:
# ! mandatory text of one character at least; ? text or null; ~ text, not applicable, or null; * list of texts;
# *~ list of texts or not applicable; *Item list of items; =Enum! and =Enum? one of an enumeration; # numbered list of texts.
ENUMS = {
    "RequirementPriority": ("MUST", "SHOULD", "COULD", "WONT"),
    "NonFunctionalCategory": ("PERFORMANCE", "AVAILABILITY", "SECURITY", "USABILITY", "MAINTAINABILITY", "COMPLIANCE", "OTHER"),
}
ITEMS = {
    "Alert": "name! condition severity response_action notification_channel",
    "Component": "name! purpose technology owner dependencies*",
    "DataStore": "name! store_type technology contents",
    "Environment": "name! purpose hosting url~ access_control notes",
    "Integration": "name! direction protocol purpose data_exchanged authentication",
    "KnownError": "title! error_id symptoms cause workaround permanent_fix~ severity status related_ticket~",
    "Kpi": "name! definition! unit target current_value measurement_frequency owner data_source~",
    "NonFunctionalRequirement": "id! category=NonFunctionalCategory! statement! target~ priority=RequirementPriority? verification~",
    "Requirement": "id! title! description! priority=RequirementPriority? rationale~ acceptance_criteria*",
    "SloObjective": "name! definition target measurement_window measurement_source breach_consequence",
    "SopProcedure": "name! purpose trigger frequency roles* prerequisites* steps# verification escalation",
    "SupportContact": "role! team contact_channel support_hours escalates_to",
}
FACTS = {
    "ApplicationOverview": "application_name! purpose! business_overview business_owner target_users* key_capabilities* out_of_scope*~ business_criticality lifecycle_status go_live_date~ technology_summary related_systems*",
    "Architecture": "architecture_style technology_stack* components*Component data_stores*DataStore integrations*Integration diagram_reference~ notes",
    "BackupRecovery": "backup_schedule~ backup_retention~ backup_location~ restore_procedure~ rpo rto disaster_recovery_plan",
    "Deployment": "release_process ci_cd_tooling release_frequency rollback_procedure configuration_management",
    "Environments": "environments*Environment notes",
    "FunctionalRequirements": "summary requirements*Requirement out_of_scope*~",
    "KnownErrors": "known_errors*KnownError notes",
    "Kpis": "kpis*Kpi notes",
    "Monitoring": "monitoring_tools* key_metrics* alerts*Alert dashboards* log_locations*",
    "NonFunctionalRequirements": "summary requirements*NonFunctionalRequirement",
    "Slo": "objectives*SloObjective notes",
    "Sop": "procedures*SopProcedure notes",
    "Support": "support_model contacts*SupportContact escalation_path incident_process runbooks*",
}
SHARED_FACTS = frozenset(("Kpis", "Slo"))
CALLER = {
    "DocumentControl": "document_id! title! document_version status owner approvers* created_date? last_updated_date?",
    "RevisionEntry": "version! date! summary! author",
    "RevisionHistory": "revisions*RevisionEntry notes",
    "MissingInfo": "field! question! expected_source!",
}
#: A section mirrors its fact field by field; of ApplicationOverview it takes these, in this order.
SUMMARY = "application_name purpose business_overview target_users key_capabilities business_criticality out_of_scope technology_summary".split()
#: Lists of items render as tables, except these.
DETAILED = frozenset((("Sop", "procedures"),))
DOCUMENTS = {
    "Overview": "application_summary=ApplicationOverview kpi_summary=Kpis",
    "SMTD": "application_summary=ApplicationOverview architecture=Architecture environments=Environments deployment=Deployment monitoring=Monitoring backup_recovery=BackupRecovery support=Support known_errors=KnownErrors standard_operating_procedures=Sop service_levels=Slo kpi_summary=Kpis",
    "SOP": "application_summary=ApplicationOverview monitoring=Monitoring support=Support standard_operating_procedures=Sop",
    "SRS": "application_summary=ApplicationOverview functional_requirements=FunctionalRequirements non_functional_requirements=NonFunctionalRequirements service_levels=Slo",
}


def title(name: str) -> str:
    """A field name as a heading (R1)."""
    return " ".join(ACRONYMS.get(w, w[:1].upper() + w[1:].lower()) for w in name.split("_"))


#: Descriptions and questions that an installation declares for its fields, by (model, field); others are derived by rule.
TEXTS: dict[tuple[str, str], dict[str, str]] = {}


def declare_texts(texts: dict[str, dict[str, str]]) -> None:
    """Takes over ``{"Model.field": {"description": ..., "question": ...}}``: rejections and missing lists then say these texts.

    A question that isn't given is the description, as with fields that are declared without one. A section's field has its fact's texts.
    Unknown fields raise.
    """
    for name, own in texts.items():
        model, _, field_name = name.partition(".")
        if model not in MODELS or field_name not in {f.name for f in MODELS[model].fields}:
            raise ValueError(f"{name} is no field of the registry")
        if unknown := set(own) - {"description", "question"}:
            raise ValueError(f"{name}: {', '.join(sorted(unknown))} is neither description nor question")
    for name, own in texts.items():
        TEXTS[tuple(name.split("."))] = dict(own)


def load_texts(path: str) -> None:
    """declare_texts() from a JSON file, or from the file that the environment's FACTLAKE_TEXTS names."""
    with open(path, encoding="utf-8") as file:
        declare_texts(json.load(file))


@dataclass(frozen=True)
class Field:
    """kind: text, texts, items, item, enum, integer, number or flag."""

    name: str
    kind: str
    mandatory: bool = False
    nullable: bool = False
    na: bool = False
    least: int = 0
    item: str | None = None
    allowed: tuple[str, ...] = ()
    default: object = None
    scored: bool = True
    binding: str = ""
    render_as: str = "list"
    owner: str = ""

    def __post_init__(self) -> None:
        if self.render_as not in RENDERINGS:
            raise ValueError(f"render_as {self.render_as!r} is none of {', '.join(RENDERINGS)}")

    @property
    def label(self) -> str:
        return title(self.name)

    @property
    def description(self) -> str:
        return TEXTS.get((self.owner, self.name), {}).get("description") or f"{self.label} of the {self._owner_words()}."

    @property
    def question(self) -> str:
        own = TEXTS.get((self.owner, self.name), {})
        return own.get("question") or own.get("description") or f"What is the {self.label.lower()} of the {self._owner_words()}?"

    def _owner_words(self) -> str:
        return " ".join(re.findall("[A-Z][a-z]*|[A-Z]+(?![a-z])", self.owner)).lower() or "object"


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[Field, ...]

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)


MODELS: dict[str, Model] = {}

_MARKED = re.compile(r"(\w+?)(?:=(\w+))?([!?~#]|\*~|\*(\w*))?")


def declared(name: str, text: str, binding: str = "", **more) -> Model:
    """A model from its declaration in the notation above."""
    fields = []
    for word in text.split():
        own, enum, mark, item = _MARKED.fullmatch(word).groups()
        mark = mark or ""
        base = Field(own, "text", owner=name, binding=binding, default="")
        if enum:
            found = replace(base, kind="enum", allowed=ENUMS[enum], mandatory=mark == "!", nullable=mark == "?", default=None)
        elif mark == "!":
            found = replace(base, mandatory=True, least=1, default=None)
        elif mark in ("?", "~"):
            found = replace(base, nullable=True, na=mark == "~", default=None)
        elif mark == "#":
            found = replace(base, kind="texts", default=(), render_as="numbered")
        elif item:
            found = replace(base, kind="items", item=item, default=(), render_as="list" if (name, own) in DETAILED else "table")
        elif mark.startswith("*"):
            found = replace(base, kind="texts", default=(), na=mark == "*~")
        else:
            found = base
        fields.append(replace(found, **more.get(own, {})))
    return Model(name, tuple(fields))


def section_of(fact: str) -> Model:
    """The section that mirrors a fact; each field is bound to ``Fact.field``."""
    source = MODELS[fact]
    names = SUMMARY if fact == "ApplicationOverview" else [f.name for f in source.fields]
    return Model(f"{'ApplicationSummary' if fact == 'ApplicationOverview' else 'KpiSummary' if fact == 'Kpis' else fact}Section", tuple(replace(source[n], binding=f"{fact}.{n}", owner=source.name) for n in names))


def _fill() -> None:
    MODELS["NotApplicable"] = declared("NotApplicable", "reason!")
    for group, binding in ((ITEMS, ""), (FACTS, ""), (CALLER, "caller")):
        for name, text in group.items():
            MODELS[name] = declared(name, text, binding)
    MODELS["SaveError"] = declared("SaveError", "path! message! error_type! received? expected? field_description? question?")
    MODELS["SaveResult"] = Model("SaveResult", (Field("ok", "flag", mandatory=True), Field("key", "text", mandatory=True, least=1), Field("action", "enum", mandatory=True, allowed=("CREATED", "UPDATED", "UNCHANGED", "REJECTED")), Field("version", "integer", nullable=True), Field("hashcode", "text", nullable=True), Field("completeness", "number", nullable=True), Field("errors", "items", item="SaveError", default=(), scored=False)))
    for fact in FACTS:
        MODELS[section_of(fact).name] = section_of(fact)
    for name, text in DOCUMENTS.items():
        parts = [w.split("=") for w in text.split()]
        MODELS[f"{name}Document"] = Model(f"{name}Document", tuple(Field(n, "item", mandatory=True, item=section_of(f).name, binding="composed", owner=name) for n, f in parts))


_fill()
if os.environ.get("FACTLAKE_TEXTS"):
    load_texts(os.environ["FACTLAKE_TEXTS"])

NA = T.StructType([T.StructField("value", T.StringType()), T.StructField("na_reason", T.StringType())])


def type_of(f: Field) -> T.DataType:
    inner: T.DataType = {"flag": T.BooleanType(), "integer": T.LongType(), "number": T.DoubleType()}.get(f.kind, T.StringType())
    if f.kind == "texts":
        inner = T.ArrayType(T.StringType())
    elif f.kind in ("items", "item"):
        inner = struct_of(MODELS[f.item]) if f.kind == "item" else T.ArrayType(struct_of(MODELS[f.item]))
    return T.StructType([T.StructField("value", inner), T.StructField("na_reason", T.StringType())]) if f.na else inner


def struct_of(model: Model) -> T.StructType:
    """The typed form: a field that may be not applicable is a struct (value, na_reason); metadata goes with each field."""
    meta = lambda f: {"question": f.question, "description": f.description, "scored": f.scored, "binding": f.binding, "render_as": f.render_as, "na_allowed": f.na}
    return T.StructType([T.StructField(f.name, type_of(f), True, meta(f)) for f in model.fields])


@dataclass(frozen=True)
class Saver:
    """What may be saved where: a model, the keys it takes, and the table it goes to."""

    model: Model
    patterns: tuple[str, ...]
    table: str = "KnowledgeFacts"
    extra: dict = field(default_factory=dict, compare=False)


def _savers() -> dict[str, Saver]:
    out = {f: Saver(MODELS[f], (f"{SHARED}.{f}",) if f in SHARED_FACTS else (f"{{app}}.{f}", f"{{app}}.Components.{{component}}.{f}")) for f in FACTS}
    out |= {d: Saver(MODELS[f"{d}Document"], (f"{{app}}.Outputs.{d}",), "DocumentOutputs") for d in DOCUMENTS}
    out |= {c: Saver(MODELS[c], (f"{{app}}.Outputs.{{doctype}}.{c}",), "DocumentOutputs") for c in ("DocumentControl", "RevisionHistory")}
    return out


SAVERS = _savers()


def bindings(doc_type: str) -> list[tuple[str, str, str, Field]]:
    """(document path, fact, source field, section field) of each bound field of a document, in order."""
    out = []
    for part in MODELS[f"{doc_type}Document"].fields:
        for f in MODELS[part.item].fields:
            fact, _, source = f.binding.partition(".")
            out.append((f"{part.name}.{f.name}", fact, source, f))
    return out
