from __future__ import annotations

import json

import pytest

from factlake.functions.registry import FACTS, SAVERS, SHARED_FACTS
from factlake.operators import build, render
from factlake.operators.save import save_batch
from factlake.plans.pipelines import seed
from factlake.sources import files

OVERVIEW = {"application_name": "Orchard", "purpose": "Counts apples.", "target_users": ["Pickers"], "out_of_scope": {"reason": "trees are counted elsewhere"}}
KPIS = {"kpis": [{"name": "Yield", "definition": "Weight of apples.", "unit": "kg|tree", "owner": "Ada\nBell", "data_source": "Scales"}], "notes": "Each autumn."}
SOP = {"procedures": [{"name": "Mow", "roles": ["Gardener"], "steps": ["Fuel up", "Mow the rows"]}]}
CONTROL = {"document_id": "O-17", "title": "Orchard at a glance", "approvers": ["A", "B"]}
HISTORY = {"revisions": [{"version": "1.0", "date": "2022-11-30", "summary": "Planted."}], "notes": "One row a year."}


def facts(spark, **payloads):
    rows = [(i, f, f"Shared.{f}" if f in SHARED_FACTS else f"Orchard.{f}", json.dumps(p), None) for i, (f, p) in enumerate(payloads.items())]
    df = spark.createDataFrame(rows, "seq long, saver string, key string, payload string, app_id string")
    return save_batch(df, None, {f: SAVERS[f] for f in payloads if f in FACTS})[1]


def outputs(spark, bodies, doc_type="Overview"):
    more = [(f"Orchard.Outputs.{doc_type}.DocumentControl", json.dumps(CONTROL)), (f"Orchard.Outputs.{doc_type}.RevisionHistory", json.dumps(HISTORY))]
    return bodies.select("key", "value").unionByName(spark.createDataFrame(more, "key string, value string"))


GOLDEN = """# Orchard at a glance

- **Document ID:** O-17
- **Version:** _Not provided._
- **Status:** _Not provided._
- **Owner:** _Not provided._
- **Approvers:** A, B
- **Created:** _Not provided._
- **Last Updated:** _Not provided._

## Revision History

| Version | Date | Author | Summary |
|---|---|---|---|
| 1.0 | 2022-11-30 | - | Planted. |

One row a year.

## Application Summary

**Application Name:** Orchard

**Purpose:** Counts apples.

**Business Overview:** _Not provided._

**Target Users:**
- Pickers

**Key Capabilities:** _Not provided._

**Business Criticality:** _Not provided._

**Out Of Scope:** _N/A — trees are counted elsewhere_

**Technology Summary:** _Not provided._


## KPI Summary

**KPIs:**

| Name | Definition | Unit | Target | Current Value | Measurement Frequency | Owner | Data Source |
|---|---|---|---|---|---|---|---|
| Yield | Weight of apples. | kg\\|tree | _Not provided._ | _Not provided._ | _Not provided._ | Ada Bell | Scales |

**Notes:** Each autumn.
"""


def test_golden_document(spark):
    bodies, failures = build.build_documents(facts(spark, ApplicationOverview=OVERVIEW, Kpis=KPIS), "Overview")
    assert failures.count() == 0
    rendered, absent = render.render_markdown(outputs(spark, bodies), "Overview")
    assert rendered.first().markdown == GOLDEN and absent.count() == 0
    assert json.loads(bodies.first().value)["application_summary"]["out_of_scope"] == {"reason": "trees are counted elsewhere"}


def test_missing_fields_in_order(spark):
    bodies, _ = build.build_documents(facts(spark, ApplicationOverview=OVERVIEW), "Overview")
    missing = [r.field for r in build.missing_rows(bodies).orderBy("ordinal").collect()]
    assert missing == [f"application_summary.{n}" for n in ("business_overview", "key_capabilities", "business_criticality", "technology_summary")] + ["kpi_summary.kpis", "kpi_summary.notes"]


def test_no_overview_no_document(spark):
    bodies, failures = build.build_documents(facts(spark, Sop=SOP), "SOP")
    assert bodies.count() == 0
    assert failures.first().unresolved[:2] == ["application_summary.application_name", "application_summary.purpose"]


def test_details_and_numbered_steps(spark):
    bodies, _ = build.build_documents(facts(spark, ApplicationOverview=OVERVIEW, Sop=SOP), "SOP")
    text = render.render_markdown(outputs(spark, bodies, "SOP"), "SOP")[0].first().markdown
    assert "**Procedures:**\n1.\n  - **Name:** Mow\n" in text
    assert "  - **Steps:**\n    1. Fuel up\n    2. Mow the rows\n" in text and "  - **Prerequisites:** _Not provided._" in text


def test_absent_rows_and_unknown_types(spark):
    bodies, _ = build.build_documents(facts(spark, ApplicationOverview=OVERVIEW), "Overview")
    _, absent = render.render_markdown(bodies, "Overview")
    assert absent.first().missing_key == "Orchard.Outputs.Overview.DocumentControl"
    with pytest.raises(render.RenderError):
        render.render_markdown(bodies, "Nothing")
    with pytest.raises(build.BuildError):
        build.build_documents(bodies, "Nothing")


def test_whole_run_and_sinks(spark, tmp_path):
    rows = [(0, "ApplicationOverview", "Orchard.ApplicationOverview", json.dumps(OVERVIEW), None), (1, "Kpis", "Shared.Kpis", json.dumps(KPIS), None)]
    requests = spark.createDataFrame(rows, "seq long, saver string, key string, payload string, app_id string")
    callers = spark.createDataFrame([("Orchard", "Overview", json.dumps(CONTROL), json.dumps(HISTORY))], "app_id string, doc_type string, control string, history string")
    run = seed(requests, callers, ("Overview",))
    files.write_markdown(run["markdown"], str(tmp_path / "md"))
    written = list((tmp_path / "md").rglob("*.txt"))
    assert [p.read_bytes().decode() for p in written if p.stat().st_size] == [GOLDEN]
    lines = [r.line for r in files.progress(run["results"]).orderBy("seq").collect()]
    assert lines[0].startswith("Orchard.ApplicationOverview: created, version 1")
    shown = files.missing_json(run["missing"].select("app_id", "missing")).first().json
    assert [m["field"] for m in json.loads(shown)][-1] == "application_summary.technology_summary"


def test_payload_files(spark, tmp_path):
    (tmp_path / "kpis").mkdir()
    (tmp_path / "kpis/a.json").write_text('{\n "kpis": []\n}')
    row = files.read_payloads(spark, str(tmp_path / "*/*.json")).first()
    assert row.folder == "kpis" and json.loads(row.payload) == {"kpis": []}
