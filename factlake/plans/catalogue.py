"""Registered queries over the driver's tables, each with its DuckDB twin.

Roles: applications are nations, the shared scope is what regions share, components are suppliers, the save log is events in
event_id order, nested lists are conversations and orders, optional information is labels.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, naming
from ..functions.canonical import canonical, canonical_struct, sha256_hex
from ..functions.registry import DOCUMENTS, FACTS, MODELS, SAVERS, Field, Model, Saver, bindings, declared
from ..operators import build, render, save, score, validate
from ..sources import files, store
from ..streaming.save_stream import save_stream
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_list(items: Column) -> Column:
    return F.parse_json(F.to_json(items, {"ignoreNullFields": "false"}))


# ---- saving -------------------------------------------------------------------------------------------------------------

ACTIVITY = Saver(declared("Activity", "event_type! note"), ("{app}.Activity",))
LOG_SQL = """log AS (SELECT event_id AS seq, 'user' || user_id || CASE WHEN event_type = 'error' THEN '..' ELSE '.' END || 'Activity' AS key, event_type <> 'error' AS ok,
  '{"event_type":"' || event_type || '","note":"' || CASE WHEN value > 50 THEN 'high' ELSE '' END || '"}' AS val, CASE WHEN value > 50 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS score FROM events),
v AS (SELECT *, sha256(val) AS hash, lag(sha256(val)) OVER (PARTITION BY key ORDER BY seq) AS prev FROM log WHERE ok),
w AS (SELECT *, CASE WHEN prev IS NULL THEN 'CREATED' WHEN prev = hash THEN 'UNCHANGED' ELSE 'UPDATED' END AS action FROM v),
r AS (SELECT *, CAST(sum(CASE WHEN action <> 'UNCHANGED' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS version FROM w)"""


def _requests(events: DataFrame) -> DataFrame:
    key = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "error", "..").otherwise("."), F.lit("Activity"))
    note = F.when(F.col("value") > 50, "high")  # absent otherwise, so the default is filled in
    payload = F.to_json(F.struct(F.col("event_type"), note.alias("note")))
    return events.select(F.col("event_id").alias("seq"), F.lit("Activity").alias("saver"), key.alias("key"), payload.alias("payload"), F.lit(None).cast("string").alias("app_id"))


def _saved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return save.save_batch(_requests(table(spark, d, "events")), None, {"Activity": ACTIVITY})


@query("""WITH l AS (SELECT event_id, 'user' || user_id || '.Activity' AS key, sha256('{"event_type":"' || event_type || '"}') AS hashcode FROM events),
v AS (SELECT *, lag(hashcode) OVER (PARTITION BY key ORDER BY event_id) AS prev FROM l),
w AS (SELECT *, CASE WHEN prev IS NULL THEN 'CREATED' WHEN prev = hashcode THEN 'UNCHANGED' ELSE 'UPDATED' END AS action FROM v)
SELECT event_id, key, hashcode, action, CAST(sum(CASE WHEN action <> 'UNCHANGED' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY event_id) AS BIGINT) AS version FROM w""")
def save_versions(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).select(F.col("seq").alias("event_id"), "key", "hashcode", "action", "version")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    value = canonical_struct(event_type=F.col("event_type"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".Activity")).alias("key"), value.alias("value"), sha256_hex(value).alias("hashcode"))
    return save.versioned(rows)


@query("""WITH l AS (SELECT event_id, 'user' || user_id || '.Activity' AS key, '{"event_type":"' || event_type || '"}' AS value FROM events),
v AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY event_id) AS prev FROM l),
w AS (SELECT *, CAST(sum(CASE WHEN prev IS DISTINCT FROM value THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY event_id) AS BIGINT) AS version, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS n FROM v)
SELECT key, value, sha256(value) AS hashcode, version FROM w WHERE n = 1""")
def save_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return save.latest(_versions(spark, d)).select("key", "value", "hashcode", "version")


@query(f"WITH {LOG_SQL} SELECT action, count(*) AS n, max(version) AS max_version FROM r GROUP BY action")
def save_action_counts(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d)[0].filter("ok").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("max_version"))


@query("""WITH l AS (SELECT event_id AS seq, 'user' || user_id || '..Activity' AS key FROM events WHERE event_type = 'error')
SELECT seq, key, 'REJECTED' AS action, 'key' AS path, 'key_pattern_mismatch' AS error_type, '"' || key || '"' AS received, 'one of: {app}.Activity' AS expected FROM l""")
def save_rejected(spark: SparkSession, d: str) -> DataFrame:
    e = F.get("errors", F.lit(0))
    return _saved(spark, d)[0].filter("not ok").select("seq", "key", "action", e["path"].alias("path"), e["error_type"].alias("error_type"), e["received"].alias("received"), e["expected"].alias("expected"))


@query(f"WITH {LOG_SQL} SELECT seq, true AS ok, key, action, version, hash AS hashcode, score AS completeness FROM r UNION ALL SELECT seq, false, key, 'REJECTED', NULL, NULL, NULL FROM log WHERE NOT ok")
def save_mixed_results(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d)[0].drop("errors")


@query(f"WITH {LOG_SQL}, half AS (SELECT max(event_id) / 2 AS m FROM events) SELECT seq, key, action, version, hash AS hashcode FROM r, half WHERE seq > m")
def save_incremental(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    middle = (events.agg(F.max("event_id")).first()[0] or 0) / 2
    saver = {"Activity": ACTIVITY}
    _, before = save.save_batch(_requests(events.filter(F.col("event_id") <= middle)), None, saver)
    return save.save_batch(_requests(events.filter(F.col("event_id") > middle)), before, saver)[0].filter("ok").select("seq", "key", "action", "version", "hashcode")


@query("""WITH s AS (SELECT user_id, count(*) AS n, min(event_type) AS least, max(event_type) AS most, max(event_id) AS seq FROM events GROUP BY user_id)
SELECT 'user' || user_id || '.Activity' AS key, CASE WHEN least = most THEN 'UNCHANGED' ELSE 'UPDATED' END AS action, CASE WHEN least = most THEN 12.5::DOUBLE ELSE 50.0::DOUBLE END AS completeness FROM s""")
def save_completeness_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Against a snapshot whose scores are stale: an unchanged object keeps the stored score, a changed one is scored anew."""
    events = table(spark, d, "events").groupBy("user_id").agg(F.min("event_type").alias("least"), F.max("event_type").alias("most"), F.max("event_id").alias("seq"))
    request = lambda kind, seq: events.select(seq.alias("seq"), F.lit("Activity").alias("saver"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".Activity")).alias("key"), F.to_json(F.struct(F.col(kind).alias("event_type"))).alias("payload"), F.lit(None).cast("string").alias("app_id"))
    _, before = save.save_batch(request("least", F.col("seq")), None, {"Activity": ACTIVITY})
    return save.save_batch(request("most", F.col("seq")), before.withColumn("completeness", F.lit(12.5)), {"Activity": ACTIVITY})[0].select("key", "action", "completeness")


@query(f"WITH {LOG_SQL} SELECT seq, key, action, version FROM r")
def save_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The save log as a stream of three batches, each against the snapshot that the one before it stored; the results must equal those of one batch."""
    where = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/stream-{uuid.uuid4().hex}"
    requests = _requests(table(spark, d, "events"))
    last = requests.agg(F.max("seq")).first()[0] or 0
    for n in range(3):
        requests.filter((F.col("seq") > last * n // 3) & (F.col("seq") <= last * (n + 1) // 3) | (F.lit(n == 0) & (F.col("seq") <= 0))).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema("seq long, saver string, key string, payload string, app_id string").parquet(f"{where}/in")
        save_stream(stream, where, {"Activity": ACTIVITY}).awaitTermination()
    return spark.read.parquet(f"{where}/results").filter("ok").select("seq", "key", "action", "version")


@query("""SELECT event_id AS seq, event_type = 'click' AS ok, CASE WHEN event_type = 'click' THEN NULL ELSE 'unknown_saver' END AS error_type,
  CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN 'null' ELSE '"' || event_type || '"' END AS received FROM events""")
def save_unknown_saver(spark: SparkSession, d: str) -> DataFrame:
    """A request whose saver is unknown or null is rejected, not lost."""
    saver = F.when(F.col("event_type") == "click", "Activity").when(F.col("event_type") != "error", F.col("event_type"))
    requests = _requests(table(spark, d, "events")).drop("saver")
    requests = requests.join(table(spark, d, "events").select(F.col("event_id").alias("seq"), saver.alias("saver")), "seq")
    return save.save_batch(requests, None, {"Activity": ACTIVITY})[0].select("seq", "ok", F.get("errors", F.lit(0))["error_type"].alias("error_type"), F.get("errors", F.lit(0))["received"].alias("received"))


#: Keys for a saver of ``{app}.Note``, one for ``Shared.Note`` and one for ``{app}.Outputs.{doctype}``; % stands for a nation's name. Which of them fits, and what is received.
KEY_CASES = [
    ("Note", "%.Note", True), ("Note", "%.note", False), ("Note", "%.Note.More", False), ("Note", "Note", False), ("Note", ".Note", False), ("Note", "%.", False), ("Note", "Shared.Note", False), ("Note", "", False), ("Note", None, False), ("Note", "%..Note", False),
    ("SharedNote", "Shared.Note", True), ("SharedNote", "shared.Note", False), ("SharedNote", "%.Note", False), ("Paper", "%.Outputs.SRS", True), ("Paper", "%.outputs.SRS", False), ("Paper", "%.Outputs.", False), ("Paper", "Shared.Outputs.SRS", False), ("Paper", "%.Note", False),
]
_NOTE = declared("Note", "note")
KEY_SAVERS = {"Note": Saver(_NOTE, ("{app}.Note",)), "SharedNote": Saver(_NOTE, ("Shared.Note",)), "Paper": Saver(_NOTE, ("{app}.Outputs.{doctype}",), "DocumentOutputs")}
_CASES_SQL = ", ".join(f"({n}, '{s}', {'NULL' if k is None else repr(k)}, {ok})" for n, (s, k, ok) in enumerate(KEY_CASES))


@query(f"""WITH c AS (SELECT n_nationkey * 100 + n AS seq, s AS saver, replace(k, '%', n_name) AS key, fits FROM nation, (VALUES {_CASES_SQL}) AS v(n, s, k, fits))
SELECT seq, fits AS ok, CASE WHEN fits THEN NULL ELSE 'key' END AS path, CASE WHEN fits THEN NULL ELSE 'key_pattern_mismatch' END AS error_type, CASE WHEN fits THEN NULL WHEN key IS NULL THEN 'null' ELSE '"' || key || '"' END AS received,
  CASE WHEN fits THEN NULL ELSE 'one of: ' || CASE saver WHEN 'Note' THEN '{{app}}.Note' WHEN 'SharedNote' THEN 'Shared.Note' ELSE '{{app}}.Outputs.{{doctype}}' END END AS expected,
  CASE WHEN coalesce(key, '') = '' THEN '(empty)' ELSE key END AS key FROM c""")
def key_reject_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Keys that fit and keys that don't, of each kind of pattern."""
    cases = spark.createDataFrame([(n, s, k) for n, (s, k, _) in enumerate(KEY_CASES)], "n int, saver string, k string")
    rows = table(spark, d, "nation").crossJoin(F.broadcast(cases)).select((F.col("n_nationkey") * 100 + F.col("n")).cast("long").alias("seq"), "saver", F.replace("k", F.lit("%"), F.col("n_name")).alias("key"), F.lit('{"note":"x"}').alias("payload"), F.lit(None).cast("string").alias("app_id"))
    e = F.get("errors", F.lit(0))
    return save.save_batch(rows, None, KEY_SAVERS)[0].select("seq", "ok", "key", *[e[n].alias(n) for n in ("path", "error_type", "received", "expected")])


# ---- keys ---------------------------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT unnest([n_name || '.Overview', 'Shared.Overview', '.Overview', n_name || '.', n_name || '..Overview', n_name || '.overview', n_name || '.Overview.X']) AS key FROM nation)
SELECT key, len(string_split(key, '.')) = 2 AND string_split(key, '.')[1] NOT IN ('', 'Shared') AND string_split(key, '.')[2] = 'Overview' AS matched FROM k""")
def key_match_app(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_name")
    made = F.array(F.concat(n, F.lit(".Overview")), F.lit("Shared.Overview"), F.lit(".Overview"), F.concat(n, F.lit(".")), F.concat(n, F.lit("..Overview")), F.concat(n, F.lit(".overview")), F.concat(n, F.lit(".Overview.X")))
    return table(spark, d, "nation").select(F.explode(made).alias("key")).withColumn("matched", keys.matches("{app}.Overview", F.col("key")))


@query("""SELECT n_name || '.Components.' || s_name || '.Monitoring' AS key, true AS matched, false AS as_app FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def key_match_component(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.concat_ws(".", "n_name", F.lit("Components"), "s_name", F.lit("Monitoring")).alias("key"))
    return rows.select("key", keys.matches_any(SAVERS["Monitoring"].patterns, F.col("key")).alias("matched"), keys.matches("{app}.Monitoring", F.col("key")).alias("as_app"))


@query("SELECT n_name || '.Overview' AS key, n_name AS app_id FROM nation UNION ALL SELECT 'Shared.' || r_name, NULL FROM region")
def key_app_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.concat("n_name", F.lit(".Overview")).alias("key")).unionByName(table(spark, d, "region").select(F.concat(F.lit("Shared."), "r_name").alias("key")))
    return rows.withColumn("app_id", keys.app_id(F.col("key")))


@query("""SELECT c_custkey, n_name || '.Support' AS key, upper(c_mktsegment) AS given, n_name AS expected FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0""")
def key_app_id_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.concat("n_name", F.lit(".Support")).alias("key"), F.when(F.col("c_acctbal") < 0, F.upper("c_mktsegment")).otherwise(F.col("n_name")).alias("given"))
    return rows.filter(~keys.app_agrees(F.col("key"), F.col("given"))).withColumn("expected", keys.app_id(F.col("key")))


@query("""WITH k AS (SELECT n_name, unnest(['.Architecture', '.Outputs.SRS', '.Outputs.SRS.DocumentControl', '.Components.x.Sop', '.Unknown']) AS tail FROM nation)
SELECT n_name || tail AS key, CASE WHEN tail LIKE '.Outputs%' THEN 'DocumentOutputs' WHEN tail <> '.Unknown' THEN 'KnowledgeFacts' END AS target FROM k
UNION ALL SELECT 'Shared.Kpis', 'KnowledgeFacts' FROM region""")
def key_routing(spark: SparkSession, d: str) -> DataFrame:
    tails = F.array(*map(F.lit, (".Architecture", ".Outputs.SRS", ".Outputs.SRS.DocumentControl", ".Components.x.Sop", ".Unknown")))
    rows = table(spark, d, "nation").select("n_name", F.explode(tails).alias("tail")).select(F.concat("n_name", "tail").alias("key"))
    rows = rows.unionByName(table(spark, d, "region").select(F.lit("Shared.Kpis").alias("key")))
    return rows.withColumn("target", keys.table_of(SAVERS, F.col("key")))


# ---- the store ----------------------------------------------------------------------------------------------------------


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as stored rows: keyed by nation and name, every fifth nation's in the shared scope."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    value = canonical_struct(name=F.col("c_name"), segment=F.col("c_mktsegment"))
    app = F.when(F.col("n_regionkey") > 0, F.col("n_name"))
    return rows.select(F.concat_ws(".", F.coalesce(app, F.lit("Shared")), "c_name").alias("FactKey"), value.alias("Value"), sha256_hex(value).alias("Hashcode"), app.alias("AppID"), F.lit(100.0).alias("Completeness"), F.lit(1).cast("long").alias("Version"))


CUSTOMERS_SQL = """c AS (SELECT coalesce(CASE WHEN n_regionkey > 0 THEN n_name END, 'Shared') || '.' || c_name AS FactKey, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS Value,
  CASE WHEN n_regionkey > 0 THEN n_name END AS AppID FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"WITH {CUSTOMERS_SQL} SELECT FactKey, Value, sha256(Value) AS Hashcode, AppID, 100.0::DOUBLE AS Completeness, 1::BIGINT AS Version FROM c ORDER BY FactKey")
def list_rows_ordered(spark: SparkSession, d: str) -> DataFrame:
    return store.list_rows(_customers(spark, d), "KnowledgeFacts")


@query(f"WITH {CUSTOMERS_SQL} SELECT FactKey, Value, AppID FROM c WHERE AppID = (SELECT max(n_name) FROM nation WHERE n_regionkey > 0) ORDER BY FactKey")
def list_rows_by_app(spark: SparkSession, d: str) -> DataFrame:
    app = table(spark, d, "nation").filter("n_regionkey > 0").agg(F.max("n_name")).first()[0]
    return store.list_rows(_customers(spark, d), "KnowledgeFacts", app).select("FactKey", "Value", "AppID")


@query(f"WITH {CUSTOMERS_SQL} SELECT FactKey, Value, AppID FROM c WHERE FactKey = (SELECT min(FactKey) FROM c)")
def get_row_point(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d)
    return store.get_row(rows, "KnowledgeFacts", rows.agg(F.min("FactKey")).first()[0]).select("FactKey", "Value", "AppID")


@query(f"""WITH {CUSTOMERS_SQL} SELECT FactKey, CASE WHEN Value LIKE '%BUILDING%' THEN upper(Value) ELSE Value END AS Value, CASE WHEN Value LIKE '%BUILDING%' THEN 2 ELSE 1 END::BIGINT AS Version FROM c""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Insert or replace of whole rows by key: old rows of replaced keys leave."""
    old = _customers(spark, d)
    new = old.filter(F.col("Value").contains("BUILDING")).withColumns({"Value": F.upper("Value"), "Version": F.col("Version") + 1})
    return old.join(new.select("FactKey"), "FactKey", "left_anti").unionByName(new).select("FactKey", "Value", "Version")


# ---- canonical form -----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(CAST(json_object('lang', lang, 'text', text) AS VARCHAR)) AS hashcode FROM documents""")
def canonical_hash_documents(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct("text", "lang"), {"ignoreNullFields": "false"})
    return table(spark, d, "documents").select("doc_id", sha256_hex(canonical(payload)).alias("hashcode"))


#: JSON texts and their canonical form, written out: numbers as JSON has them, keys by code point, escapes in lower case, the last of repeated keys.
CANONICAL_CASES = [
    ('{"b": 1.0, "a": -0.0}', '{"a":-0.0,"b":1.0}'), ("[1e2, 1E-7, 0.1, 1.5e300]", "[100.0,1e-07,0.1,1.5e+300]"), ("[12345678901234567890123456789012345678901, -0, 7]", "[12345678901234567890123456789012345678901,0,7]"),
    ('{"\U0001f600": 1, "\uffee": 2, "z": 3}', '{"z":3,"\uffee":2,"\U0001f600":1}'), ('{"k": "\\u001F\\u000b\\n\\\\u001F"}', '{"k":"\\u001f\\u000b\\n\\\\u001F"}'), ('{"k": 1, "j": 2, "k": 3}', '{"j":2,"k":3}'), (' { "x" : [ ] , "w" : { } } ', '{"w":{},"x":[]}'),
    ('"\\u00e9 \\/"', '"\u00e9 /"'), ("{broken", None), ("", None), ("NaN", None), ("null", "null"), ('{"v": "1.0, 2.5e3", "n": 12}', '{"n":12,"v":"1.0, 2.5e3"}'),
]
_CANONICAL_SQL = ", ".join(f"({n}, {'NULL' if c is None else chr(39) + c + chr(39)})" for n, (_, c) in enumerate(CANONICAL_CASES))


@query(f"SELECT n_nationkey, n, c AS canonical, sha256(c) AS hashcode FROM nation, (VALUES {_CANONICAL_SQL}) AS v(n, c)")
def canonical_numbers_and_keys(spark: SparkSession, d: str) -> DataFrame:
    """Canonical forms that a plain reading of JSON would miss."""
    cases = spark.createDataFrame([(n, j) for n, (j, _) in enumerate(CANONICAL_CASES)], "n int, j string")
    rows = table(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(cases))
    return rows.select("n_nationkey", "n", canonical(F.col("j")).alias("canonical")).withColumn("hashcode", sha256_hex(F.col("canonical")))


@query("""SELECT page_id, sha256(CAST(json_object('html', html, 'url', url) AS VARCHAR)) AS hashcode FROM pages""")
def canonical_hash_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", sha256_hex(canonical_struct(url=F.col("url"), html=F.col("html"))).alias("hashcode"))


@query("""SELECT sha256(CAST(json_object('lang', lang, 'text', text) AS VARCHAR)) AS hashcode, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""")
def canonical_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", sha256_hex(canonical_struct(text=F.col("text"), lang=F.col("lang"))).alias("hashcode"))
    return rows.groupBy("hashcode").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


# ---- validation ---------------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


def _violations(rows: DataFrame, model: Model, payload: Column, *keep: str) -> DataFrame:
    found = rows.select(*keep, F.explode(validate.payload_errors(model, payload)).alias("e"))
    return found.select(*keep, "e.*")


RATED = declared("Rated", "quality! lang")


@query("SELECT doc_id, 'quality' AS path, 'missing' AS error_type, 'Field required' AS message, CAST(NULL AS VARCHAR) AS received, 'a value for this field' AS expected FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def validate_missing(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("quality").cast("string").alias("quality"), "lang"))
    return _violations(_labelled(spark, d), RATED, payload, "doc_id").select("doc_id", "path", "error_type", "message", "received", "expected")


@query("SELECT doc_id, 'quality' AS path, 'string_too_short' AS error_type, 'String should have at least 1 character' AS message, '\"\"' AS received FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def validate_min_length(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumn("p", F.to_json(F.struct(F.when(F.col("toxic") == 1, "").otherwise("fine").alias("quality"))))
    return _violations(rows, RATED, F.col("p"), "doc_id").select("doc_id", "path", "error_type", "message", "received")


@query("SELECT doc_id, 'quality' AS path, 'string_type' AS error_type, CAST(quality AS VARCHAR) AS received, 'a valid string' AS expected FROM documents JOIN labels USING (doc_id)")
def validate_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumn("p", F.to_json(F.struct(F.col("quality").alias("quality"))))
    return _violations(rows.filter("quality is not null"), RATED, F.col("p"), "doc_id").select("doc_id", "path", "error_type", "received", "expected")


URGENCY = Model("Order", (MODELS["Requirement"]["priority"].__class__("urgency", "enum", mandatory=True, allowed=("1-URGENT", "2-HIGH", "3-MEDIUM"), owner="Order"),))


@query("""SELECT o_orderkey, 'urgency' AS path, 'enum' AS error_type, '"' || o_orderpriority || '"' AS received, '''1-URGENT'', ''2-HIGH'' or ''3-MEDIUM''' AS expected FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def validate_enum(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("o_orderpriority").alias("urgency")))
    return _violations(table(spark, d, "orders"), URGENCY, payload, "o_orderkey").select("o_orderkey", "path", "error_type", "received", "expected")


@query("SELECT event_id, unnest(json_keys(props)) AS path, 'extra_forbidden' AS error_type, 'no such field; remove it' AS expected FROM events")
def validate_extra_keys(spark: SparkSession, d: str) -> DataFrame:
    return _violations(table(spark, d, "events"), declared("Props", "note"), F.col("props"), "event_id").select("event_id", "path", "error_type", "expected")


@query("""SELECT doc_id, '{"lang":"' || lang || '","quality":"' || CAST(quality AS VARCHAR) || '","remark":"","tags":[],"toxic":' || CASE WHEN toxic = 1 THEN '"yes"' ELSE 'null' END || '}' AS value FROM documents JOIN labels USING (doc_id)""")
def validate_default_fill(spark: SparkSession, d: str) -> DataFrame:
    model = declared("Filled", "quality! lang remark tags* toxic?")
    rows = _labelled(spark, d).withColumn("p", F.try_parse_json(F.to_json(F.struct(F.col("quality").cast("string").alias("quality"), F.col("lang"), F.when(F.col("toxic") == 1, "yes").alias("toxic")))))
    return rows.filter(F.size(validate.errors(model, F.col("p"))) == 0).select("doc_id", F.to_json(validate.normal(model, F.col("p"))).alias("value"))


MODELS["Turn"] = Model("Turn", (MODELS["Requirement"]["priority"].__class__("role", "enum", mandatory=True, allowed=("user", "assistant"), owner="Turn"), *declared("Turn", "text! note").fields))
CONVERSATION = declared("Conversation", "title turns*Turn")


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    """conv_id and its turns in order; turns with equal numbers follow their role and text."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))


TURNS_SQL = "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)"


@query(f"WITH {TURNS_SQL} SELECT conv_id, 'turns.' || i || '.role' AS path, 'enum' AS error_type, '\"' || role || '\"' AS received FROM t WHERE role NOT IN ('user', 'assistant')")
def validate_error_paths(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))
    return _violations(_conversations(spark, d), CONVERSATION, payload, "conv_id").filter("error_type = 'enum'").select("conv_id", "path", "error_type", "received")


@query("""SELECT doc_id, 3::BIGINT AS n_errors, 'quality:missing,lang:string_type,spare:extra_forbidden' AS said FROM documents""")
def validate_all_errors(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("n_chars").alias("lang"), F.col("source").alias("spare")))
    rows = table(spark, d, "documents").select("doc_id", validate.payload_errors(RATED, payload).alias("errors"))
    return rows.select("doc_id", F.size("errors").cast("long").alias("n_errors"), F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["error_type"])), ",").alias("said"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'url.str:string_type,url.NotApplicable.reason:string_too_short' ELSE '' END AS said FROM documents JOIN labels USING (doc_id)""")
def validate_union(spark: SparkSession, d: str) -> DataFrame:
    """Both members of a union complain if neither takes the value."""
    reason = F.when(F.col("toxic") == 1, "").otherwise("not asked")
    payload = F.to_json(F.struct(F.struct(reason.alias("reason")).alias("url")))
    rows = _labelled(spark, d).filter("toxic is not null").select("doc_id", validate.payload_errors(declared("Linked", "url~"), payload).alias("errors"))
    return rows.select("doc_id", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["error_type"])), ",").alias("said"))


# ---- completeness -------------------------------------------------------------------------------------------------------

FLAT = declared("Flat", "text! lang source quality? toxic~")


def _scored(rows: DataFrame, model: Model, own: Column, *keep: str) -> DataFrame:
    out = rows.select(*keep, score.counts(model, own).alias("c")).select(*keep, "c.answered", "c.total")
    return out.withColumn("completeness", score.percent(F.col("answered"), F.col("total")))


@query("""WITH c AS (SELECT doc_id, CAST(1 + (CASE WHEN lang <> '' THEN 1 ELSE 0 END) + (CASE WHEN source <> '' THEN 1 ELSE 0 END) + (CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN toxic = 1 OR quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS answered, 5::BIGINT AS total FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, answered, total, answered / total * 100 AS completeness FROM c""")
def completeness_flat(spark: SparkSession, d: str) -> DataFrame:
    na = F.when(F.col("toxic") == 1, F.struct(F.lit(None).cast("string").alias("value"), F.lit("toxic").alias("na_reason"))).when(F.col("quality") == 1, F.struct(F.lit("no").alias("value"), F.lit(None).cast("string").alias("na_reason")))
    own = F.struct("text", "lang", "source", F.col("quality").cast("string").alias("quality"), na.alias("toxic"))
    return _scored(_labelled(spark, d), FLAT, own, "doc_id")


def _turns_typed() -> Column:
    return F.struct(F.lit("").alias("title"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.when(t["role"] == "system", "s").otherwise("").alias("note"))).alias("turns"))


@query("""WITH c AS (SELECT conv_id, CAST(sum(2 + CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS BIGINT) AS answered, CAST(3 * count(*) + 1 AS BIGINT) AS total FROM conversations GROUP BY conv_id)
SELECT conv_id, answered, total, answered / total * 100 AS completeness FROM c""")
def completeness_nested(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_conversations(spark, d), CONVERSATION, _turns_typed(), "conv_id")


@query("""SELECT n_name AS app_id, count(*) AS customers, CAST(sum(CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END) AS BIGINT) AS answered, CAST(2 * count(*) AS BIGINT) AS total, min(CASE WHEN c_acctbal > 0 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END) AS worst FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def completeness_by_app(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.struct(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("").alias("segment"))
    each = _scored(rows, declared("Customer", "name! segment"), own, "n_name")
    return each.groupBy(F.col("n_name").alias("app_id")).agg(F.count(F.lit(1)).alias("customers"), F.sum("answered").alias("answered"), F.sum("total").alias("total"), F.min("completeness").alias("worst"))


@query("""SELECT c_custkey, CAST(1 + CASE WHEN count(o_orderkey) > 0 THEN 1 ELSE 0 END AS BIGINT) AS answered, 2::BIGINT AS total, (1 + CASE WHEN count(o_orderkey) > 0 THEN 1 ELSE 0 END) / 2 * 100 AS completeness FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def completeness_empty_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of orders is one leaf, unanswered when it is empty. Only its length matters, so counts are shuffled, not orders."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    own = F.struct(F.col("c_name").alias("name"), F.when(F.col("n") > 0, F.array(F.lit("order"))).otherwise(F.array().cast("array<string>")).alias("orders"))
    return _scored(rows, declared("Buyer", "name! orders*"), own, "c_custkey")


# ---- building -----------------------------------------------------------------------------------------------------------


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Stored facts: an overview per nation outside region 0, a monitoring fact per supplier (a component), shared KPIs."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    segments = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))  # five segments
    nations = nations.join(segments, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    text = lambda model, *columns: F.to_json(validate.normal(MODELS[model], F.try_parse_json(F.to_json(F.struct(*columns))))).alias("value")
    overview = nations.filter("n_regionkey > 0").select(F.concat_ws(".", "n_name", F.lit("ApplicationOverview")).alias("key"), text("ApplicationOverview", F.col("n_name").alias("application_name"), F.concat(F.lit("Serves "), "r_name").alias("purpose"), F.coalesce("segments", F.array().cast("array<string>")).alias("target_users"), F.when(F.col("n_nationkey") > 12, "Tier 1").alias("business_criticality")))
    plain = nations.filter("n_regionkey = 0").select(F.concat_ws(".", "n_name", F.lit("Deployment")).alias("key"), text("Deployment", F.lit("Weekly").alias("release_process")))
    suppliers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    component = suppliers.select(F.concat_ws(".", "n_name", F.lit("Components"), "s_name", F.lit("ApplicationOverview")).alias("key"), text("ApplicationOverview", F.col("s_name").alias("application_name"), F.lit("A component").alias("purpose")))
    kpis = F.array_sort(F.collect_list(F.struct(F.col("r_name").alias("name"), F.concat(F.lit("Share of "), "r_name").alias("definition"))))
    shared = table(spark, d, "region").agg(kpis.alias("kpis")).select(F.lit("Shared.Kpis").alias("key"), text("Kpis", "kpis", F.lit("Looked at each Monday.").alias("notes")))
    return overview.unionByName(plain).unionByName(component).unionByName(shared)


SEGMENTS_SQL = "s AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS seg FROM customer GROUP BY 1), n AS (SELECT nation.*, r_name, coalesce(seg, []) AS seg FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON c_nationkey = n_nationkey WHERE n_regionkey > 0)"


@query(f"WITH {SEGMENTS_SQL} SELECT n_name AS app_id, n_name AS application_name, 'Serves ' || r_name AS purpose, CASE WHEN n_nationkey > 12 THEN 'Tier 1' ELSE '' END AS business_criticality, len(seg)::BIGINT AS n_users, (SELECT count(*) FROM region) AS n_kpis, 'Looked at each Monday.' AS notes FROM n")
def build_document_fields(spark: SparkSession, d: str) -> DataFrame:
    b = build.build_documents(_facts(spark, d), "Overview")[0]
    s, k = "body.application_summary", "body.kpi_summary"
    return b.select("app_id", f"{s}.application_name", f"{s}.purpose", f"{s}.business_criticality", F.size(f"{s}.target_users").cast("long").alias("n_users"), F.size(f"{k}.kpis").cast("long").alias("n_kpis"), f"{k}.notes")


def _missing_sql(doc_type: str) -> str:
    """The fields that no nation's facts answer, and those that some do not."""
    have = {"ApplicationOverview.application_name", "ApplicationOverview.purpose", "Kpis.kpis", "Kpis.notes"}
    some = {"ApplicationOverview.business_criticality": "n_nationkey <= 12", "ApplicationOverview.target_users": "len(seg) = 0"}
    rows = [f"({i}, '{path}', '{f.question}', '{f.binding}')" for i, (path, _, _, f) in enumerate(bindings(doc_type)) if f.binding not in have]
    when = " AND ".join(f"(expected_source <> '{b}' OR {test})" for b, test in some.items())
    return f"WITH {SEGMENTS_SQL}, m AS (SELECT * FROM (VALUES {', '.join(rows)}) AS x(o, field, question, expected_source)), j AS (SELECT n_name AS app_id, o, field, question, expected_source FROM n, m WHERE {when}) SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY o) - 1 AS INTEGER) AS ordinal, field, question, expected_source FROM j"


@query(_missing_sql("SMTD"))
def build_missing(spark: SparkSession, d: str) -> DataFrame:
    return build.missing_rows(build.build_documents(_facts(spark, d), "SMTD")[0])


@query("SELECT n_name AS app_id, r_name AS kpi, 'Looked at each Monday.' AS notes FROM nation, region WHERE n_regionkey > 0")
def build_shared_broadcast(spark: SparkSession, d: str) -> DataFrame:
    b = build.build_documents(_facts(spark, d), "Overview")[0]
    return b.select("app_id", F.explode("body.kpi_summary.kpis.name").alias("kpi"), F.col("body.kpi_summary.notes").alias("notes"))


@query("""SELECT n_name AS app_id, 'application_summary.application_name,application_summary.purpose,application_summary.business_overview,application_summary.target_users,application_summary.key_capabilities,application_summary.business_criticality,application_summary.out_of_scope,application_summary.technology_summary' AS unresolved
FROM nation WHERE n_regionkey = 0""")
def build_mandatory_failures(spark: SparkSession, d: str) -> DataFrame:
    failed = build.build_documents(_facts(spark, d), "SMTD")[1]
    return failed.select("app_id", F.array_join("unresolved", ",").alias("unresolved"))


NOTHING_SQL = """(SELECT string_agg('{"current_value":"","data_source":null,"definition":"Share of ' || r_name || '","measurement_frequency":"","name":"' || r_name || '","owner":"","target":"","unit":""}', ',' ORDER BY r_name) FROM region)"""


@query(f"""WITH {SEGMENTS_SQL} SELECT n_name AS app_id, n_name || '.Outputs.Overview' AS key, '{{"application_summary":{{"application_name":"' || n_name || '","business_criticality":"' || CASE WHEN n_nationkey > 12 THEN 'Tier 1' ELSE '' END || '","business_overview":"","key_capabilities":[],"out_of_scope":[],"purpose":"Serves ' || r_name || '","target_users":[' || array_to_string(list_transform(seg, lambda x: '"' || x || '"'), ',') || '],"technology_summary":""}},"kpi_summary":{{"kpis":[' || {NOTHING_SQL} || '],"notes":"Looked at each Monday."}}}}' AS value FROM n""")
def build_nested_body(spark: SparkSession, d: str) -> DataFrame:
    return build.build_documents(_facts(spark, d), "Overview")[0].select("app_id", "key", "value")


@query("SELECT count(*) FILTER (WHERE n_regionkey > 0) AS bodies, 0::BIGINT AS from_components FROM nation")
def build_component_ignored(spark: SparkSession, d: str) -> DataFrame:
    b = build.build_documents(_facts(spark, d), "Overview")[0]
    return b.agg(F.count(F.lit(1)).alias("bodies"), F.count(F.when(F.col("body.application_summary.purpose") == "A component", 1)).alias("from_components"))


# ---- rendering ----------------------------------------------------------------------------------------------------------


#: Headings written out.
_TITLES = {"kpi_summary": "KPI Summary", "kpis": "KPIs", "ci_cd_tooling": "CI CD Tooling", "rpo": "RPO", "rto": "RTO", "slos": "SLOs", "error_id": "Error ID", "url": "URL", "id": "ID", "out_of_scope": "Out Of Scope", "sop_notes": "SOP Notes", "smtd": "SMTD", "srs": "SRS", "a": "A", "idle": "Idle"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in _TITLES.items()) + """) AS x(name, title)
UNION ALL SELECT replace(lower(n_name), ' ', '_'), array_to_string(list_transform(string_split(replace(lower(n_name), ' ', '_'), '_'), lambda w: upper(w[1]) || w[2:]), ' ') FROM nation""")
def render_title(spark: SparkSession, d: str) -> DataFrame:
    """Field names as headings: acronyms, and nations as names of several words."""
    names = spark.createDataFrame([(n,) for n in _TITLES], "name string").unionByName(table(spark, d, "nation").select(F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")).alias("name")))
    return names.withColumn("title", render.title_of(F.col("name")))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN '_N/A — toxic in ' || source || '_' WHEN quality = 1 THEN lang ELSE '_Not provided._' END AS shown FROM documents LEFT JOIN labels USING (doc_id)""")
def render_scalar(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("toxic") == 1, F.concat(F.lit("toxic in "), "source"))
    value = F.when(F.col("quality") == 1, F.col("lang")).when(F.col("quality") == 0, F.lit(""))
    return _labelled(spark, d).select("doc_id", render.scalar(value, reason).alias("shown"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY i) AS lines FROM t GROUP BY conv_id")
def render_list_bullets(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).select("conv_id", F.array_join(render.list_lines(F.col("turns.text")), "\n").alias("lines"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, string_agg('    ' || (i + 1) || '. ' || text, chr(10) ORDER BY i) AS lines FROM t GROUP BY conv_id")
def render_list_numbered(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).select("conv_id", F.array_join(render.list_lines(F.col("turns.text"), "numbered", "    "), "\n").alias("lines"))


@query(r"SELECT doc_id, sha256(replace(replace(text, '|', '\|'), chr(10), ' ')) AS cell_sha256 FROM documents")
def render_table_cell(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sha256_hex(render.cell(F.col("text"))).alias("cell_sha256"))


MODELS["SupplierLine"] = declared("SupplierLine", "name! supplier_id note")


@query("""SELECT n_name AS app_id, '| Name | Supplier ID | Note |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || s_name || ' | ' || s_suppkey || ' | _Not provided._ |', chr(10) ORDER BY s_name) || chr(10) AS lines FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def render_item_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    items = F.sort_array(F.collect_list(F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("supplier_id"), F.lit("").alias("note"))))
    return rows.groupBy(F.col("n_name").alias("app_id")).agg(items.alias("i")).select("app_id", F.array_join(render.item_table(MODELS["SupplierLine"], F.col("i")), "\n").alias("lines"))


@query(f"""WITH {TURNS_SQL} SELECT conv_id, string_agg((i + 1) || '.' || chr(10) || '  - **Role:** ' || role || chr(10) || '  - **Text:** ' || coalesce(nullif(text, ''), '_Not provided._') || chr(10) || '  - **Note:** ' || CASE WHEN role = 'system' THEN 's' ELSE '_Not provided._' END, chr(10) ORDER BY i) AS lines FROM t GROUP BY conv_id""")
def render_item_details(spark: SparkSession, d: str) -> DataFrame:
    numbered = F.transform("x.turns", lambda t, i: F.concat(F.array(F.concat((i + 1).cast("string"), F.lit("."))), render.item_lines(MODELS["Turn"], t)))
    return _conversations(spark, d).select("conv_id", _turns_typed().alias("x")).select("conv_id", F.array_join(F.flatten(numbered), "\n").alias("lines"))


def _callers(spark: SparkSession, d: str) -> DataFrame:
    """Control and history of each nation's documents, as JSON; nations of the last region lack a history."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    control = F.to_json(F.struct(F.concat("n_name", F.lit("-DOC-7")).alias("document_id"), F.concat("n_name", F.lit(" Overview")).alias("title"), F.lit("1.0").alias("document_version"), F.array("r_name", F.lit("Lead")).alias("approvers")))
    history = F.to_json(F.struct(F.array(F.struct(F.lit("1.0").alias("version"), F.lit("2023-05-09").alias("date"), F.concat(F.lit("Made for "), "r_name").alias("summary"))).alias("revisions")))
    return rows.select(F.col("n_name").alias("app_id"), F.explode(F.array(*map(F.lit, DOCUMENTS))).alias("doc_type"), control.alias("control"), F.when(F.col("n_regionkey") < 4, history).alias("history"))


CONTROL_SQL = """'# ' || n_name || ' Overview' || chr(10) || chr(10) || '- **Document ID:** ' || n_name || '-DOC-7' || chr(10) || '- **Version:** 1.0' || chr(10) || '- **Status:** _Not provided._' || chr(10) || '- **Owner:** _Not provided._' || chr(10) || '- **Approvers:** ' || r_name || ', Lead' || chr(10) || '- **Created:** _Not provided._' || chr(10) || '- **Last Updated:** _Not provided._'"""
HISTORY_SQL = """'## Revision History' || chr(10) || chr(10) || '| Version | Date | Author | Summary |' || chr(10) || '|---|---|---|---|' || chr(10) || '| 1.0 | 2023-05-09 | - | Made for ' || r_name || ' |'"""


@query(f"SELECT n_name AS app_id, {CONTROL_SQL} AS block FROM nation JOIN region ON n_regionkey = r_regionkey")
def render_control(spark: SparkSession, d: str) -> DataFrame:
    rows = _callers(spark, d).filter("doc_type = 'Overview'")
    return rows.select("app_id", validate.typed(MODELS["DocumentControl"], F.try_parse_json("control")).alias("c")).select("app_id", render.control_block(F.col("c")).alias("block"))


@query(f"SELECT n_name AS app_id, {HISTORY_SQL} AS block FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 4")
def render_history(spark: SparkSession, d: str) -> DataFrame:
    rows = _callers(spark, d).filter("doc_type = 'Overview' and history is not null")
    return rows.select("app_id", validate.typed(MODELS["RevisionHistory"], F.try_parse_json("history")).alias("h")).select("app_id", render.history_block(F.col("h")).alias("block"))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    bodies = build.build_documents(_facts(spark, d), "Overview")[0].select("key", "value")
    callers = _callers(spark, d).filter("doc_type = 'Overview'")
    part = lambda name, column: callers.select(keys.output_key(F.col("app_id"), F.col("doc_type"), name).alias("key"), F.col(column).alias("value")).filter("value is not null")
    return bodies.unionByName(part("DocumentControl", "control")).unionByName(part("RevisionHistory", "history"))


_GAP = "chr(10) || chr(10)"
_LINE = lambda label, text: f"'**{label}:** ' || {text} || {_GAP}"
BODY_SQL = " || ".join([
    f"'## Application Summary' || {_GAP}", _LINE("Application Name", "n_name"), _LINE("Purpose", "'Serves ' || r_name"), _LINE("Business Overview", "'_Not provided._'"),
    f"CASE WHEN len(seg) > 0 THEN '**Target Users:**' || chr(10) || array_to_string(list_transform(seg, lambda x: '- ' || x), chr(10)) || {_GAP} ELSE '**Target Users:** _Not provided._' || {_GAP} END",
    _LINE("Key Capabilities", "'_Not provided._'"), _LINE("Business Criticality", "CASE WHEN n_nationkey > 12 THEN 'Tier 1' ELSE '_Not provided._' END"), _LINE("Out Of Scope", "'_Not provided._'"), _LINE("Technology Summary", "'_Not provided._'"),
    f"chr(10) || '## KPI Summary' || {_GAP}", f"'**KPIs:**' || {_GAP}", "'| Name | Definition | Unit | Target | Current Value | Measurement Frequency | Owner | Data Source |' || chr(10) || '|---|---|---|---|---|---|---|---|' || chr(10)",
    f"(SELECT string_agg('| ' || r_name || ' | Share of ' || r_name || ' |' || repeat(' _Not provided._ |', 6), chr(10) ORDER BY r_name) FROM region) || {_GAP}", "'**Notes:** Looked at each Monday.'",
])


@query(f"WITH {SEGMENTS_SQL} SELECT n_name AS app_id, 'Overview' AS doc_type, {CONTROL_SQL} || {_GAP} || {HISTORY_SQL} || {_GAP} || {BODY_SQL} || chr(10) AS markdown FROM n WHERE n_regionkey < 4")
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return render.render_markdown(_outputs(spark, d), "Overview")[0]


@query("SELECT n_name AS app_id, n_name || '.Outputs.Overview' || CASE WHEN n_regionkey = 4 THEN '.RevisionHistory' ELSE '' END AS missing_key FROM nation WHERE n_regionkey IN (0, 4)")
def render_missing_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.render_markdown(_outputs(spark, d), "Overview")[1]


# ---- whole runs and tools -----------------------------------------------------------------------------------------------


def _seeded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Each nation saves an overview without, then with its users; region 0 saves another fact; KPIs are shared."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    payload = lambda *c: F.to_json(F.struct(F.col("n_name").alias("application_name"), F.concat(F.lit("Serves "), "r_name").alias("purpose"), *c))
    request = lambda rows, seq, saver, key, text: rows.select(seq.cast("long").alias("seq"), F.lit(saver).alias("saver"), key.alias("key"), text.alias("payload"), F.lit(None).cast("string").alias("app_id"))
    key = F.concat_ws(".", "n_name", F.lit("ApplicationOverview"))
    first = request(nations, F.col("n_nationkey"), "ApplicationOverview", key, payload())
    second = request(nations, F.col("n_nationkey") + 1000, "ApplicationOverview", key, payload(F.array("r_name").alias("target_users")))
    kpis = table(spark, d, "region").agg(F.array_sort(F.collect_list(F.struct(F.col("r_name").alias("name"), F.lit("Share").alias("definition")))).alias("kpis"))
    shared = request(kpis, F.lit(5000), "Kpis", F.lit("Shared.Kpis"), F.to_json(F.struct("kpis")))
    return pipelines.seed(first.unionByName(second).unionByName(shared), _callers(spark, d), ("Overview", "SRS"))


@query("""WITH p AS (SELECT n_name, n_regionkey, unnest(['Overview', 'SRS']) AS doc_type FROM nation) SELECT n_name AS app_id, doc_type, 2::BIGINT AS fact_version, n_regionkey < 4 AS rendered, CASE doc_type WHEN 'Overview' THEN 6 ELSE 12 END::BIGINT AS n_missing FROM p""")
def sample_pipeline(spark: SparkSession, d: str) -> DataFrame:
    run = _seeded(spark, d)
    versions = run["facts"].filter(F.col("key").endswith("ApplicationOverview")).select("app_id", F.col("version").alias("fact_version"))
    out = run["missing"].join(versions, "app_id").join(run["markdown"].select("app_id", "doc_type", F.lit(True).alias("rendered")), ["app_id", "doc_type"], "left")
    return out.select("app_id", "doc_type", "fact_version", F.coalesce("rendered", F.lit(False)).alias("rendered"), F.size("missing").cast("long").alias("n_missing"))


@query("SELECT n_name || '.ApplicationOverview' AS key, unnest(['created', 'updated']) AS became FROM nation UNION ALL SELECT 'Shared.Kpis', 'created'")
def progress_log(spark: SparkSession, d: str) -> DataFrame:
    lines = files.progress(_seeded(spark, d)["results"])
    return lines.select(F.split("line", ": ")[0].alias("key"), F.split(F.split("line", ": ")[1], ",")[0].alias("became"))


@query("SELECT n_name AS app_id, '[' || chr(10) || '  {' || chr(10) || '    \"field\": \"kpi_summary.kpis\",' || chr(10) || '    \"question\": \"What is it?\",' || chr(10) || '    \"expected_source\": \"Kpis.kpis\"' || chr(10) || '  }' || chr(10) || ']' AS json FROM nation WHERE n_regionkey > 0 UNION ALL SELECT n_name, '[]' FROM nation WHERE n_regionkey = 0")
def missing_sink(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct(F.lit("kpi_summary.kpis").alias("field"), F.lit("What is it?").alias("question"), F.lit("Kpis.kpis").alias("expected_source"))
    rows = table(spark, d, "nation").select(F.col("n_name").alias("app_id"), F.when(F.col("n_regionkey") > 0, F.array(entry)).otherwise(F.slice(F.array(entry), 1, 0)).alias("missing"))
    return files.missing_json(rows)


_MODEL_NAMES = sorted([*FACTS, "HTTPServer", "APIKeyV2"])


@query("SELECT name, lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, regexp_full_match(name, '[A-Z][A-Za-z0-9]*') AS pascal FROM (VALUES " + ", ".join(f"('{n}')" for n in _MODEL_NAMES) + ") AS x(name)")
def naming_tools(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in _MODEL_NAMES], "name string")
    return rows.select("name", naming.to_snake(F.col("name")).alias("snake"), naming.is_pascal(F.col("name")).alias("pascal"))


#: Declarations and key patterns that break a rule each.
_BAD_FIELDS = (
    Field("BadName", "text", default="", owner="Bad"), Field("both", "text", mandatory=True, na=True, owner="Bad"), Field("given", "text", mandatory=True, default="x", owner="Bad"), Field("short", "texts", least=2, default=(), owner="Bad"), Field("choice", "enum", nullable=True, owner="Bad"),
    Field("bound", "text", default="", binding="Kpis.notes", owner="Bad"), Field("twice", "text", default="", owner="Bad"), Field("twice", "text", default="", owner="Bad"),
)
_BAD_PATTERNS = (("entity", "app.Note"), ("entity", "{app}"), ("entity", "{app}..Note"), ("document", "{app}.SRS"))
_PROBLEMS = [
    "twice: declared twice", "BadName: the name isn't snake case", "both: a mandatory field can't be not applicable", "given: a mandatory field has no default", "short: a least length is for text", "choice: an enumeration has no values", "bound: an entity's field has no binding",
    "app.Note: must start with {app} or Shared", "{app}: has an empty segment or only one", "{app}..Note: has an empty segment or only one", "{app}.SRS: documents are kept under .Outputs.",
]


@query("SELECT problem FROM (VALUES " + ", ".join("('" + p.replace("'", "''") + "')" for p in _PROBLEMS) + ") AS x(problem)")
def registry_lint(spark: SparkSession, d: str) -> DataFrame:
    """Problems of declarations and key patterns: of the registry's there are none, of bad ones each rule's."""
    own = [p for n in FACTS for p in naming.model_problems(MODELS[n], document=False)] + naming.model_problems(Model("Bad", _BAD_FIELDS), document=False)
    own += [p for s in SAVERS.values() for pattern in s.patterns for p in keys.pattern_problems("document" if s.table == "DocumentOutputs" else "entity", pattern)]
    own += [p for kind, pattern in _BAD_PATTERNS for p in keys.pattern_problems(kind, pattern)]
    return spark.createDataFrame([(p,) for p in own], "problem string")


_NONE = "_Not provided._"
_LINES_SRS = ["'## Functional Requirements'", "''", f"'**Summary:** {_NONE}'", "''", "'**Requirements:**'", "''", "'| ID | Title | Description | Priority | Rationale | Acceptance Criteria |'", "'|---|---|---|---|---|---|'", f"'| R-' || n_nationkey || ' | Serve ' || r_name || ' | Within a\\| day. | MUST | {_NONE} | {_NONE} |'", f"'| S-' || n_nationkey || ' | Stay up | Always. | {_NONE} | _N/A — asked for_ | {_NONE} |'", "''", f"'**Out Of Scope:** {_NONE}'"]
_LINES_SOP = ["'## Standard Operating Procedures'", "''", "'**Procedures:**'", "'1.'", "'  - **Name:** Restart ' || n_name", *[f"'  - **{x}:** {_NONE}'" for x in ("Purpose", "Trigger", "Frequency")], "'  - **Roles:**'", "'    - Operator'", f"'  - **Prerequisites:** {_NONE}'", "'  - **Steps:**'", "'    1. Stop'", "'    2. Start'", f"'  - **Verification:** {_NONE}'", f"'  - **Escalation:** {_NONE}'", "''", f"'**Notes:** {_NONE}'"]
_LINES_SMTD = ["'## Deployment'", "''", "'**Release Process:** By ' || r_name", "''", *sum(([f"'**{x}:** {_NONE}'", "''"] for x in ("CI CD Tooling", "Release Frequency", "Rollback Procedure")), []), "'**Configuration Management:** Files'"]
_SECTIONS = {"SRS": ("## Functional Requirements", _LINES_SRS), "SOP": ("## Standard Operating Procedures", _LINES_SOP), "SMTD": ("## Deployment", _LINES_SMTD)}


@query(" UNION ALL ".join(f"SELECT n_name AS app_id, '{t}' AS doc_type, concat_ws(chr(10), {', '.join(lines)}) AS section FROM nation JOIN region ON n_regionkey = r_regionkey" for t, (_, lines) in _SECTIONS.items()))
def document_pipelines(spark: SparkSession, d: str) -> DataFrame:
    """Facts saved, then SRS, SOP and SMTD built, stored and rendered for every nation; of each document one section with what was saved."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name, region = F.col("n_name"), F.col("r_name")
    item = lambda **c: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in c.items()]))
    list_of = lambda key, *items: F.concat(F.lit(f'{{"{key}":['), F.concat_ws(",", *items), F.lit("]}"))
    asked = list_of("requirements", item(id=F.concat(F.lit("R-"), "n_nationkey"), title=F.concat(F.lit("Serve "), region), description="Within a| day.", priority="MUST"), item(id=F.concat(F.lit("S-"), "n_nationkey"), title="Stay up", description="Always.", rationale=F.struct(F.lit("asked for").alias("reason"))))
    payloads = {
        "ApplicationOverview": item(application_name=name, purpose=F.concat(F.lit("Serves "), region)),
        "FunctionalRequirements": asked,
        "Sop": list_of("procedures", item(name=F.concat(F.lit("Restart "), name), roles=F.array(F.lit("Operator")), steps=F.array(F.lit("Stop"), F.lit("Start")))),
        "Deployment": item(release_process=F.concat(F.lit("By "), region), configuration_management="Files"),
    }
    each = [nations.select((F.col("n_nationkey") * 10 + i).cast("long").alias("seq"), F.lit(saver).alias("saver"), F.concat_ws(".", name, F.lit(saver)).alias("key"), p.alias("payload"), F.lit(None).cast("string").alias("app_id")) for i, (saver, p) in enumerate(payloads.items())]
    requests = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    control, history = item(document_id=F.concat(F.lit("D-"), "n_nationkey"), title=name), F.lit('{"revisions":[]}')
    callers = nations.select(name.alias("app_id"), F.explode(F.array(*map(F.lit, _SECTIONS))).alias("doc_type"), control.alias("control"), history.alias("history"))
    shown = pipelines.seed(requests, callers, tuple(_SECTIONS))["markdown"]
    head = F.create_map(*[F.lit(x) for t, (h, _) in _SECTIONS.items() for x in (t, h)])[F.col("doc_type")]
    after = F.element_at(F.split("markdown", F.concat(F.lit("\n"), head, F.lit("\n"))), 2)
    return shown.select("app_id", "doc_type", F.concat(head, F.lit("\n"), F.regexp_replace(F.split(after, "\n## ")[0], r"\n+\z", "")).alias("section"))
