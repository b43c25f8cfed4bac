"""Saving: an ordered log of save requests against a snapshot, as one set-based plan over all keys.

Rejected requests leave before versions are counted. Versions come from comparing each valid request with the one before it; a
key's log is cut into stretches of ``STRETCH`` sequence numbers, counted apart and put together from one row per stretch, so
that one key with a third of all requests doesn't run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.canonical import json_string, lower_escapes, sha256_hex
from ..functions.registry import SAVERS, Saver
from . import score, validate

STRETCH = 1_000_000
KEY_DESCRIPTION = "The key of an object names its scope (an application, or Shared) and what it is."


def versioned(valid: DataFrame, snapshot: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """valid(seq, key, hashcode, ...) with action and version; snapshot(key, hashcode, version) is what was stored before.

    A request is CREATED, UPDATED or UNCHANGED against the latest state only, so going back to an older value is an update.
    """
    rows = valid.withColumn("_part", F.floor(F.col("seq") / stretch))
    here = Window.partitionBy("key", "_part").orderBy("seq")
    rows = rows.withColumn("_before", F.lag("hashcode").over(here)).withColumn("_first", F.row_number().over(here) == 1)
    rows = rows.withColumn("_inner", F.sum(F.when(~F.col("_first") & (F.col("hashcode") != F.col("_before")), 1).otherwise(0)).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("key", "_part").agg(F.min_by("hashcode", "seq").alias("_from"), F.max_by("hashcode", "seq").alias("_to"), F.max("_inner").alias("_changes"))
    known = (snapshot if snapshot is not None else valid.limit(0).withColumn("version", F.lit(0).cast("long"))).select("key", F.col("hashcode").alias("_stored"), F.col("version").alias("_had"))
    parts = parts.join(known, "key", "left")
    order = Window.partitionBy("key").orderBy("_part")
    parts = parts.withColumn("_prior", F.coalesce(F.lag("_to").over(order), F.col("_stored")))
    parts = parts.withColumn("_opens", F.when(F.col("_prior").eqNullSafe(F.col("_from")), 0).otherwise(1))
    total = F.sum(F.col("_changes") + F.col("_opens")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select("key", "_part", "_prior", "_opens", (F.coalesce("_had", F.lit(0)) + total - F.col("_changes") - F.col("_opens")).cast("long").alias("_base"))
    rows = rows.join(parts, ["key", "_part"])
    before = F.when(F.col("_first"), F.col("_prior")).otherwise(F.col("_before"))
    action = F.when(before.isNull(), "CREATED").when(before == F.col("hashcode"), "UNCHANGED").otherwise("UPDATED")
    version = (F.col("_base") + F.col("_opens") + F.col("_inner")).cast("long")
    return rows.select(*valid.columns, action.alias("action"), version.alias("version"))


def latest(rows: DataFrame, key: str = "key") -> DataFrame:
    """The last row of each key by seq: partial maxima before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "seq").alias("r")).select(key, "r.*")


def _key_errors(saver: Saver, name: str) -> tuple[Column, Column]:
    """Of a key that fits no pattern, and of an application that isn't the key's: the error."""
    patterns = ", ".join(saver.patterns)
    shown = json_string(F.col("key"))
    own = json_string(keys.app_id(F.col("key")))
    bad_key = validate._error(F.lit("key"), F.concat(F.lit("Key "), shown, F.lit(f" fits no key pattern of {name}")), "key_pattern_mismatch", shown, f"one of: {patterns}", None, KEY_DESCRIPTION, f"Under which key does this {saver.model.name} belong? One of: {patterns}")
    bad_app = validate._error(F.lit("app_id"), F.concat(F.lit("Application "), json_string(F.col("app_id")), F.lit(" isn't that of key "), shown, F.lit(", which is "), own), "app_id_mismatch", json_string(F.col("app_id")), own, None, KEY_DESCRIPTION, "Which application does this key belong to?")
    return bad_key, bad_app


def checked(requests: DataFrame, savers: dict[str, Saver] | None = None) -> DataFrame:
    """requests(seq, saver, key, payload, app_id) with errors, table and, if there are no errors, value, hashcode, app and completeness.

    One pass over the requests; each is checked by its own saver. A null or unknown saver is an error of the request.
    """
    savers = SAVERS if savers is None else savers
    none = F.array().cast(f"array<{validate.ERROR}>")
    names = ", ".join(savers)
    unknown = F.array(validate._error(F.lit("saver"), F.lit("No saver of this name"), "unknown_saver", json_string(F.col("saver")), f"one of: {names}", None, "The saver tells an object's kind.", "Of which kind is this object?"))

    def by_saver(of, otherwise: Column) -> Column:
        for name, saver in savers.items():
            otherwise = F.when(F.col("saver") == name, of(name, saver)).otherwise(otherwise)
        return otherwise

    def found(name: str, saver: Saver) -> Column:
        bad_key, bad_app = _key_errors(saver, name)
        return F.when(~keys.matches_any(saver.patterns, F.col("key")), F.array(bad_key)).when(~keys.app_agrees(F.col("key"), F.col("app_id")), F.array(bad_app)).otherwise(validate.errors(saver.model, F.col("_v")))

    rows = requests.withColumn("_v", F.coalesce(F.try_parse_json("payload"), F.parse_json(F.lit("null"))))
    rows = rows.withColumn("errors", by_saver(found, unknown)).withColumn("errors", F.coalesce("errors", none))
    good = F.size("errors") == 0
    rows = rows.withColumn("_normal", F.when(good, by_saver(lambda _, s: validate.normal(s.model, F.col("_v")), F.lit(None).cast("variant"))))
    rows = rows.withColumn("value", lower_escapes(F.to_json("_normal"))).withColumn("hashcode", sha256_hex(F.col("value")))
    scored = by_saver(lambda _, s: score.completeness(s.model, validate.typed(s.model, F.col("_normal"))), F.lit(None).cast("double"))
    kept = rows.withColumns({"completeness": F.when(good, scored), "app": keys.app_id(F.col("key")), "table": by_saver(lambda _, s: F.lit(s.table), F.lit(None).cast("string"))})
    return kept.select("seq", "key", "app_id", "errors", "value", "hashcode", "completeness", "app", "table")


def save_batch(requests: DataFrame, snapshot: DataFrame | None = None, savers: dict[str, Saver] | None = None, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(results, new snapshot) of requests(seq, saver, key, payload, app_id); seq orders them and is unique.

    results: seq, ok, key, action, version, hashcode, completeness, errors, one per request. snapshot: key, value, hashcode,
    app_id, completeness, version, table. A null or empty key, payload or saver is a rejected request; no requests give no results.
    """
    return committed(checked(requests, savers), snapshot, stretch)


def committed(done: DataFrame, snapshot: DataFrame | None = None, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """What save_batch() gives, from checked() requests; a caller that wants both results can write those once."""
    valid = done.filter(F.size("errors") == 0).drop("errors", "app_id")
    kept = versioned(valid, snapshot, stretch)
    if snapshot is not None:  # an unchanged object keeps its stored score
        stored = snapshot.select("key", F.col("hashcode").alias("_h"), F.col("completeness").alias("_c"), F.col("version").alias("_n"))
        kept = kept.join(stored, "key", "left").withColumn("completeness", F.when((F.col("_h") == F.col("hashcode")) & (F.col("_n") == F.col("version")), F.col("_c")).otherwise(F.col("completeness"))).drop("_h", "_c", "_n")
    none = F.array().cast(f"array<{validate.ERROR}>")
    rejected = done.filter(F.size("errors") > 0).select("seq", F.lit(False).alias("ok"), F.coalesce(F.nullif("key", F.lit("")), F.lit("(empty)")).alias("key"), F.lit("REJECTED").alias("action"), F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("hashcode"), F.lit(None).cast("double").alias("completeness"), "errors")
    results = kept.select("seq", F.lit(True).alias("ok"), "key", "action", "version", "hashcode", "completeness", none.alias("errors")).unionByName(rejected)
    columns = ["key", "value", "hashcode", "app_id", "completeness", "version", "table"]
    new = latest(kept.withColumnRenamed("app", "app_id").select("seq", *columns)).select(*columns)
    if snapshot is not None:
        new = new.unionByName(snapshot.select(*columns).join(new.select("key"), "key", "left_anti"))
    return results, new
