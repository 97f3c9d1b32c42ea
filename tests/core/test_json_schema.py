"""Schemas as expressions: each rule kept and broken."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.json_schema import violations

NODE = {"$defs": {"node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "next": {"$ref": "#/$defs/node"}}}}, "$ref": "#/$defs/node"}
UUID = "123e4567-e89b-12d3-a456-426614174000"
CASES = [
    ({"type": "integer"}, [1, 1.0, -0, 2**53 - 1], [(1.5, "$", "type"), ("1", "$", "type"), (2**53, "$", "type"), (True, "$", "type"), (None, "$", "type")]),
    ({"type": ["number", "null"]}, [1.5, None, 1e300], [("x", "$", "type"), ([], "$", "type")]),
    ({"type": "boolean"}, [True, False], [(0, "$", "type")]),
    ({"const": {"b": [1, None], "a": "é"}}, [{"a": "é", "b": [1, None]}], [({"a": "é", "b": [1]}, "$", "const"), (None, "$", "const")]),
    ({"const": 1}, [1, 1.0], [(True, "$", "const"), ("1", "$", "const"), (2, "$", "const")]),
    ({"enum": ["a", None, 2.5, False]}, ["a", None, 2.5, False], [("b", "$", "enum"), (0, "$", "enum")]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "😀😀😀", 7], [("a", "$", "minLength"), ("abcd", "$", "maxLength")]),
    ({"pattern": "b+$"}, ["abb", 3], [("ba", "$", "pattern")]),
    ({"format": "uuid"}, [UUID, UUID.upper()], [(UUID[:-1], "$", "format"), (UUID.replace("12d3", "92d3"), "$", "format")]),
    ({"minimum": 2, "maximum": 3}, [2, 3, 2.5, "9"], [(1.99, "$", "minimum"), (4, "$", "maximum")]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, "1"], {}], [([], "$", "minItems"), ([1, 2, 3], "$", "maxItems"), ([{"a": 1, "b": 2}, {"b": 2, "a": 1}], "$", "uniqueItems")]),
    ({"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False}, [["a", 1], ["a"], []], [(["a", "b"], "$[1]", "type"), (["a", 1, 2], "$", "items")]),
    ({"items": {"type": "object", "properties": {"x": {"maximum": 1}}}}, [[{"x": 1}, {}], []], [([{"x": 1}, {"x": 2}], "$[1].x", "maximum"), ([{}, 3], "$[1]", "type")]),
    ({"minProperties": 1, "maxProperties": 2, "required": ["a"]}, [{"a": None}, []], [({"b": 1}, "$.a", "required"), ({"a": 1, "b": 2, "c": 3}, "$", "maxProperties")]),
    ({"minProperties": 1}, [{"a": 1}, 3], [({}, "$", "minProperties")]),
    ({"properties": {"a b": {"type": "null"}}, "additionalProperties": False}, [{"a b": None}, {}], [({"a b": 1}, "$.a b", "type"), ({"c.d": 1}, "$.c.d", "additionalProperties")]),
    ({"properties": {"a": {}}, "additionalProperties": {"type": "string"}}, [{"a": 1, "b": "x"}], [({"a": 1, "b": 2}, "$.b", "type")]),
    ({"additionalProperties": {"type": "string"}}, [{"b": "x"}, 4], [({"b": 2}, "$.b", "type")]),
    ({"allOf": [{"minimum": 1}, {"type": "integer"}]}, [1], [(0, "$", "minimum")]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 3, None], [(2, "$", "anyOf")]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, [1, 3.5], [(4, "$", "oneOf"), (1.5, "$", "oneOf")]),
    (NODE, [{"v": 1}, {"v": 1, "next": {"v": 2, "next": {"v": 3}}}], [({"v": 1, "next": {"v": 2, "next": {"v": "x"}}}, "$.next.next.v", "type"), ({"v": 1, "next": {"next": {"v": 1}}}, "$.next.v", "required")]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_rules(spark, case):
    schema, sound, broken = CASES[case]
    rows = [(i, json.dumps(v)) for i, v in enumerate([*sound, *[b[0] for b in broken]])]
    got = {r.i: [tuple(v) for v in r.v] for r in spark.createDataFrame(rows, "i int, j string").select("i", violations(F.col("j"), schema).alias("v")).collect()}
    assert [got[i] for i in range(len(sound))] == [[]] * len(sound)
    assert [got[len(sound) + i] for i in range(len(broken))] == [[(path, rule)] for _, path, rule in broken]


def test_several_faults_other_schemas_and_what_is_no_json(spark):
    schema = {"$defs": {"tag": {"type": "string"}}, "type": "object", "required": ["a"], "properties": {"b": {"$ref": "other"}, "t": {"$ref": "#/$defs/tag"}}}
    others = {"other": {"$defs": {"tag": {"type": "integer"}}, "$ref": "#/$defs/tag"}}
    rows = spark.createDataFrame([(1, '{"b": "x", "t": 1}'), (2, "{"), (3, None), (4, "null")], "i int, j string")
    got = {r.i: [tuple(v) for v in r.v] for r in rows.select("i", violations(F.col("j"), schema, others).alias("v")).collect()}
    assert got == {1: [("$.a", "required"), ("$.b", "type"), ("$.t", "type")], 2: [("$", "json")], 3: [("$", "json")], 4: [("$", "type")]}
    deep = json.dumps({"v": 1, "next": {"v": 1, "next": {"v": 1, "next": {"v": 1, "next": {"v": 1}}}}})
    (row,) = spark.createDataFrame([(deep,)], "j string").select(violations(F.col("j"), NODE, depth=6).alias("v")).collect()
    assert [r.rule for r in row.v] == ["depth"]
    for bad in ({"$ref": "#/$defs/none"}, {"$ref": "elsewhere"}, {"allOf": [3]}):
        with pytest.raises(ValueError):
            violations(F.col("j"), bad)


def test_messages_are_dealt_over_the_cores(spark, sf_dir):
    from millrace.plans import exchange

    assert "Repartition" in exchange.message_violations(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
