from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factlake.functions import keys, naming
from factlake.functions.canonical import canonical, canonical_struct, sha256_hex
from factlake.functions.registry import CALLER, MODELS, SAVERS, Field, bindings, declared, struct_of, title

GOOD = ["TestApp.Thing", "TestApp.Components.dbmcp.Thing"]
BAD = ["TestApp.Other", "TestApp.Thing.Extra", "Thing", "TestApp.", ".Thing", "TestApp..Thing", "testapp.thing", "Shared.Thing", "TestApp.Components..Thing", "TestApp.Components.Thing", "", None, "TestApp.Thing\n"]


def test_key_patterns(spark):
    rows = spark.createDataFrame([(k,) for k in GOOD + BAD], "key string")
    patterns = ("{app}.Thing", "{app}.Components.{component}.Thing")
    got = [r[0] for r in rows.select(keys.matches_any(patterns, F.col("key"))).collect()]
    assert got == [True] * len(GOOD) + [False] * len(BAD)


def test_shared_keys_and_application(spark):
    rows = spark.createDataFrame([("Shared.Kpis", None), ("A.Kpis", "A"), ("A.Kpis", "B"), ("Shared.Kpis", "A"), (None, None)], "key string, app string")
    got = rows.select(keys.matches("Shared.Kpis", F.col("key")), keys.app_id(F.col("key")), keys.app_agrees(F.col("key"), F.col("app"))).collect()
    assert [tuple(r) for r in got] == [(True, None, True), (False, "A", True), (False, "A", False), (True, None, False), (False, None, True)]


def test_registry_is_whole():
    assert len(MODELS["ApplicationOverview"].fields) == 12
    assert {d: len(bindings(d)) for d in ("Overview", "SMTD", "SOP", "SRS")} == {"Overview": 10, "SMTD": 47, "SOP": 20, "SRS": 15}
    assert [f.name for n, m in MODELS.items() if not n.startswith("Test") for f in m.fields if not f.scored] == ["errors"]
    assert MODELS["SopProcedure"]["steps"].render_as == "numbered" and MODELS["Sop"]["procedures"].render_as == "list"
    for name, model in MODELS.items():
        if name in SAVERS or name.endswith("Section"):
            document = name.endswith("Section") or name in CALLER
            assert not naming.model_problems(model, document), name


def test_field_metadata_goes_with_the_type():
    field = struct_of(MODELS["Kpi"])["name"]
    assert field.metadata["question"].endswith("?") and field.metadata["render_as"] == "list"


def test_declarations_are_checked():
    with pytest.raises(ValueError, match="render_as"):
        Field("x", "text", render_as="grid")
    assert naming.field_problems(Field("BadName", "text", mandatory=True, na=True, default=None, owner="Thing"), False)
    assert keys.pattern_problems("entity", "app.Thing") and not keys.pattern_problems("document", "{app}.Outputs.SRS")
    assert keys.sample_key("{app}.Outputs.{doctype}.X") == "TestApp.Outputs.TESTDOC.X"


def test_titles():
    assert [title(n) for n in ("out_of_scope", "ci_cd_tooling", "kpis", "rpo")] == ["Out Of Scope", "CI CD Tooling", "KPIs", "RPO"]


def test_canonical_text_and_hash(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": {"d": null, "c": "Küche"}, "l": [2, 1]}',), ("no json",), (None,)], "j string")
    got = [r[0] for r in rows.select(canonical(F.col("j"))).collect()]
    assert got == ['{"a":{"c":"Küche","d":null},"b":1,"l":[2,1]}', None, None]
    one = spark.range(1).select(canonical_struct(b=F.lit(None).cast("string"), a=F.lit("x")), sha256_hex(F.lit("Küche"))).first()
    assert one[0] == '{"a":"x","b":null}' and len(one[1]) == 64


def test_declared_notation():
    m = declared("T", "a! b c? d~ e* f*~ g*Kpi h=RequirementPriority! i=RequirementPriority? j#")
    assert [(f.kind, f.mandatory, f.nullable, f.na) for f in m.fields] == [("text", True, False, False), ("text", False, False, False), ("text", False, True, False), ("text", False, True, True), ("texts", False, False, False), ("texts", False, False, True), ("items", False, False, False), ("enum", True, False, False), ("enum", False, True, False), ("texts", False, False, False)]


def test_an_installation_declares_its_own_texts(tmp_path):
    from factlake.functions import registry

    field = registry.MODELS["Support"]["contacts"]
    by_rule = field.question
    path = tmp_path / "texts.json"
    path.write_text('{"Support.contacts": {"description": "People on duty", "question": "Who is on duty?"}, "Kpis.notes": {"description": "What else there is to say"}}')
    try:
        registry.load_texts(str(path))
        assert (field.question, field.description) == ("Who is on duty?", "People on duty")
        assert registry.MODELS["Kpis"]["notes"].question == "What else there is to say"
        section = next(f for p, fact, _, f in registry.bindings("SMTD") if p == "support.contacts")
        assert section.question == "Who is on duty?"
        for wrong in ({"Nothing.x": {}}, {"Support.x": {}}, {"Support.contacts": {"label": "x"}}):
            with pytest.raises(ValueError):
                registry.declare_texts(wrong)
    finally:
        registry.TEXTS.clear()
    assert field.question == by_rule
