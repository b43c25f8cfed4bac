"""Whole runs: save requests, build documents, store them with their control and history, render."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.registry import SAVERS
from ..operators.build import build_documents
from ..operators.render import render_markdown
from ..operators.save import save_batch


def seed(requests: DataFrame, callers: DataFrame, doc_types: tuple[str, ...], snapshot: DataFrame | None = None) -> dict[str, DataFrame]:
    """Saves facts, then builds, stores and renders documents of the types for all applications.

    requests: seq, saver, key, payload, app_id. callers: app_id, doc_type, control, history (JSON text).
    Facts and bodies are persisted, since several results read them. Gives results, facts, markdown (app_id, doc_type, markdown), missing (app_id, doc_type, missing) and failures.
    """
    there = {r.saver for r in requests.filter(F.col("saver").isin(*SAVERS)).select("saver").distinct().collect()}  # as many as the registry has, at most
    results, facts = save_batch(requests, snapshot, {n: s for n, s in SAVERS.items() if n in there})
    facts = facts.persist()
    markdown = missing = failures = None
    for doc_type in doc_types:
        bodies, failed = build_documents(facts, doc_type)
        bodies = bodies.persist()
        mine = callers.filter(F.col("doc_type") == doc_type)
        part = lambda name, column: mine.select(keys.output_key(F.col("app_id"), F.col("doc_type"), name).alias("key"), F.col(column).alias("value")).filter("value is not null")  # noqa: E731, B023
        outputs = bodies.select("key", "value").unionByName(part("DocumentControl", "control")).unionByName(part("RevisionHistory", "history"))
        shown, _ = render_markdown(outputs, doc_type)
        lacks = bodies.select("app_id", F.lit(doc_type).alias("doc_type"), "missing")
        failed = failed.withColumn("doc_type", F.lit(doc_type))
        markdown = shown if markdown is None else markdown.unionByName(shown)
        missing = lacks if missing is None else missing.unionByName(lacks)
        failures = failed if failures is None else failures.unionByName(failed)
    return {"results": results, "facts": facts, "markdown": markdown, "missing": missing, "failures": failures}

