from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from factlake.functions.registry import Saver, declared
from factlake.operators.save import latest, save_batch, versioned
from factlake.sources import store
from factlake.streaming.save_stream import save_stream

SAVERS = {"Note": Saver(declared("Note", "text! extra"), ("{app}.Note",))}
SCHEMA = "seq long, saver string, key string, payload string, app_id string"


def request(seq, key, app=None, **payload):
    return (seq, "Note", key, json.dumps(payload), app)


def outcome(results):
    return [(r.ok, r.key, r.action, r.version, r.completeness) for r in results.orderBy("seq").collect()]


def test_actions_versions_and_rejections(spark):
    rows = [request(0, "A.Note", text="x"), request(1, "A.Note", extra="", text="x"), request(2, "A.Note", text="y"), request(3, "A.Note", text=""), request(4, "A.Note", text="x"), request(5, "Shared.Note", text="x"), request(6, "", text="x"), request(7, "B.Note", "C", text="x"), request(8, "B.Note", "B", text="x", extra="e"), (9, "Note", None, "{}", None)]
    results, snapshot = save_batch(spark.createDataFrame(rows, SCHEMA), None, SAVERS)
    assert outcome(results) == [
        (True, "A.Note", "CREATED", 1, 50.0), (True, "A.Note", "UNCHANGED", 1, 50.0), (True, "A.Note", "UPDATED", 2, 50.0), (False, "A.Note", "REJECTED", None, None), (True, "A.Note", "UPDATED", 3, 50.0),
        (False, "Shared.Note", "REJECTED", None, None), (False, "(empty)", "REJECTED", None, None), (False, "B.Note", "REJECTED", None, None), (True, "B.Note", "CREATED", 1, 100.0), (False, "(empty)", "REJECTED", None, None),
    ]
    assert sorted((r.key, r.version, r.app_id, r.table) for r in snapshot.collect()) == [("A.Note", 3, "A", "KnowledgeFacts"), ("B.Note", 1, "B", "KnowledgeFacts")]
    kinds = {r.seq: r.errors[0].error_type for r in results.filter("not ok").collect()}
    assert kinds == {3: "string_too_short", 5: "key_pattern_mismatch", 6: "key_pattern_mismatch", 7: "app_id_mismatch", 9: "key_pattern_mismatch"}


def test_saving_again_changes_nothing(spark):
    rows = spark.createDataFrame([request(i, f"A{i}.Note", text="x") for i in range(5)], SCHEMA)
    _, snapshot = save_batch(rows, None, SAVERS)
    stored = snapshot.withColumn("completeness", F.lit(12.5))
    results, after = save_batch(rows, stored, SAVERS)
    assert {(r.action, r.version, r.completeness) for r in results.collect()} == {("UNCHANGED", 1, 12.5)}
    assert after.count() == 5


def fold(rows):
    state, out = {}, []
    for seq, key, value in sorted(rows):
        old = state.get(key)
        action = "CREATED" if old is None else "UNCHANGED" if old[0] == value else "UPDATED"
        state[key] = (value, (old[1] if old else 0) + (action != "UNCHANGED"))
        out.append((seq, action, state[key][1]))
    return out


def test_versions_equal_a_fold_whatever_the_stretch(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaab"), rng.choice("xyz")) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, key string, hashcode string")
    for stretch in (1, 7, 50, 1000):
        got = [(r.seq, r.action, r.version) for r in versioned(df, stretch=stretch).orderBy("seq").collect()]
        assert got == fold(rows)
    first, second = df.filter("seq < 200"), df.filter("seq >= 200")
    snapshot = latest(versioned(first))
    got = [(r.seq, r.action, r.version) for r in versioned(second, snapshot, 13).orderBy("seq").collect()]
    assert got == fold(rows)[200:]


def test_empty_log(spark):
    results, snapshot = save_batch(spark.createDataFrame([], SCHEMA), None, SAVERS)
    assert results.count() == 0 and snapshot.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [request(i, f"{rng.choice('AB')}.Note", text=rng.choice("xyz")) for i in range(40)]
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    save_stream(stream, str(tmp_path / "out"), SAVERS).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/results"))
    assert outcome(got) == outcome(save_batch(spark.createDataFrame(rows, SCHEMA), None, SAVERS)[0])


def test_store(spark, tmp_path):
    import pytest

    spark.conf.set(store.SETTING, str(tmp_path / "store"))
    store.init_schema(spark)
    store.init_schema(spark)
    row = lambda key, app, n: (key, "{}", "h", app, 50.0, n)
    write = lambda *rows: store.write_rows(spark, "KnowledgeFacts", spark.createDataFrame(list(rows), store.schema("KnowledgeFacts")))
    write(row("é.X", "é", 1), row("a.X", "a", 1), row("Shared.X", None, 1))
    write(row("a.X", "a", 2), row("_.X", "_", 1))
    rows = store.read_table(spark, "KnowledgeFacts")
    assert [(r.FactKey, r.Version) for r in store.list_rows(rows, "KnowledgeFacts").collect()] == [("Shared.X", 1), ("_.X", 1), ("a.X", 2), ("é.X", 1)]
    assert [r.FactKey for r in store.list_rows(rows, "KnowledgeFacts", "a").collect()] == ["a.X"]
    assert store.list_rows(rows, "KnowledgeFacts", "x' OR '1'='1").count() == 0
    assert store.get_row(rows, "KnowledgeFacts", "a.X").first().Version == 2
    assert store.get_row(rows, "KnowledgeFacts", "none").first() is None
    assert store.get_rows(rows, "KnowledgeFacts", spark.createDataFrame([("a.X",), ("a.X",), ("q",)], "key string")).count() == 1
    assert store.read_table(spark, "DocumentOutputs").count() == 0
    with pytest.raises(ValueError, match="no table"):
        store.key_column("Other")
    spark.conf.unset(store.SETTING)


def test_requests_without_a_known_saver_are_rejected(spark):
    rows = [(1, "Nobody", "A.Kpis", "{}", None), (2, None, None, None, None)]
    requests = spark.createDataFrame(rows, "seq long, saver string, key string, payload string, app_id string")
    results, snapshot = save_batch(requests)
    got = {r.seq: r for r in results.collect()}
    assert len(got) == 2 and not any(r.ok for r in got.values()) and {r.errors[0].error_type for r in got.values()} == {"unknown_saver"}
    assert got[1].errors[0].received == '"Nobody"' and got[2].errors[0].received == "null" and snapshot.count() == 0
