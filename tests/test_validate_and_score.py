from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factlake.functions.registry import MODELS, Field, Model, declared
from factlake.operators import score, validate

MODELS["TestStop"] = declared("TestStop", "name! phone?")
PARCEL = Model("Parcel", (*declared("Parcel", "name! weight? stops*TestStop customs~ tags* scope*~").fields, Field("speed", "enum", allowed=("slow", "fast"), default=None, nullable=True, owner="Parcel")))


def paths(spark, model, payload):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    row = spark.createDataFrame([(text,)], "p string").select(validate.payload_errors(model, F.col("p")).alias("e")).first()
    return [(e.path, e.error_type) for e in row.e]


def test_valid_payload_has_no_errors(spark):
    assert paths(spark, PARCEL, {"name": "x", "stops": [{"name": "a"}], "customs": {"reason": "none"}, "tags": ["t"], "scope": [], "speed": "slow"}) == []
    assert paths(spark, PARCEL, {"name": " ", "customs": None, "weight": None, "speed": None}) == []


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ({}, [("name", "missing")]),
        ({"name": ""}, [("name", "string_too_short")]),
        ({"name": 5}, [("name", "string_type")]),
        ({"name": None}, [("name", "string_type")]),
        ({"name": "x", "other": 1}, [("other", "extra_forbidden")]),
        ({"name": "x", "speed": "SLOW"}, [("speed", "enum")]),
        ({"name": "x", "stops": {}}, [("stops", "list_type")]),
        ({"name": "x", "stops": [{"name": "a"}, {"phone": "1", "z": 1}, "s"]}, [("stops.1.name", "missing"), ("stops.1.z", "extra_forbidden"), ("stops.2", "model_type")]),
        ({"name": "x", "customs": 5}, [("customs.str", "string_type"), ("customs.NotApplicable", "model_type")]),
        ({"name": "x", "customs": {}}, [("customs.str", "string_type"), ("customs.NotApplicable.reason", "missing")]),
        ({"name": "x", "scope": None}, [("scope.list[str]", "list_type"), ("scope.NotApplicable", "model_type")]),
        ({"name": "x", "tags": ["a", 1]}, [("tags.1", "string_type")]),
        ({"weight": 1, "tags": None, "q": 1}, [("name", "missing"), ("weight", "string_type"), ("tags", "list_type"), ("q", "extra_forbidden")]),
        ("text", [("payload", "model_type")]),
        ("[1]", [("payload", "model_type")]),
        ("null", [("payload", "model_type")]),
        ("{broken", [("payload", "model_type")]),
    ],
)
def test_violations(spark, payload, expected):
    assert paths(spark, PARCEL, payload) == expected


def test_error_record(spark):
    rows = spark.createDataFrame([('{"name": "x", "speed": "mid", "extra": [1]}',)], "p string")
    first, second = rows.select(validate.payload_errors(PARCEL, F.col("p")).alias("e")).first().e
    assert first.expected == "'slow' or 'fast'" and first.received == '"mid"' and first.question.endswith("?")
    assert second.expected == "no such field; remove it" and second.received == "[1]" and "name" in second.question


def test_defaults_are_filled_and_keys_sorted(spark):
    row = spark.createDataFrame([('{"name":"n","stops":[{"name":"a"}]}',)], "p string").select(F.to_json(validate.normal(PARCEL, F.parse_json("p"))).alias("v")).first()
    assert row.v == '{"customs":null,"name":"n","scope":[],"speed":null,"stops":[{"name":"a","phone":null}],"tags":[],"weight":null}'


MODELS["TestLeaf"] = declared("TestLeaf", "name! note?")
MODELS["TestBare"] = Model("TestBare", (Field("x", "text", default="", scored=False, owner="TestBare"),))
HOLDER = declared("Holder", "title? leaves*TestLeaf tags* out*~ customs~")


def counted(spark, model, payload):
    v = F.parse_json("p")
    row = spark.createDataFrame([(json.dumps(payload),)], "p string").select(score.counts(model, validate.typed(model, validate.normal(model, v))).alias("c"), score.completeness(model, validate.typed(model, validate.normal(model, v))).alias("f")).first()
    return (row.c.answered, row.c.total), row.f


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ({}, (0, 5)),
        ({"title": ""}, (1, 5)),
        ({"leaves": [{"name": "a", "note": "n"}, {"name": "b"}]}, (3, 8)),
        ({"tags": ["a", "b"]}, (1, 5)),
        ({"out": {"reason": "r"}, "customs": {"reason": "r"}}, (2, 5)),
        ({"out": ["x"], "customs": "u"}, (2, 5)),
        ({"tags": [], "title": None}, (0, 5)),
    ],
)
def test_counts(spark, payload, expected):
    assert counted(spark, HOLDER, payload)[0] == expected


def test_scores_at_the_edges(spark):
    assert counted(spark, MODELS["TestBare"], {}) == ((0, 0), 100.0)
    mandatory = Model("M", (Field("leaf", "item", mandatory=True, item="TestLeaf", owner="M"), Field("leaves", "items", mandatory=True, item="TestLeaf", owner="M")))
    assert counted(spark, mandatory, {"leaf": {"name": "a"}, "leaves": []})[0] == (2, 3)
    assert counted(spark, mandatory, {"leaf": {"name": "a"}, "leaves": [{"name": "b"}]})[0] == (2, 4)
    nested = Model("N", (Field("leaf", "item", item="TestLeaf", nullable=True, default=None, owner="N"), Field("bare", "item", item="TestBare", nullable=True, default=None, owner="N")))
    assert counted(spark, nested, {})[0] == (0, 2)
    assert counted(spark, nested, {"leaf": {"name": "a"}, "bare": {}})[0] == (2, 3)
    assert counted(spark, declared("F", "a b c d e f g h i j k l m n o p q r s t u v w x y"), {c: "x" for c in "abcdefghijklmn"})[1] == 14 / 25 * 100
