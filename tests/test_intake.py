import json

import pytest
from conftest import at
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulbook.functions import json as fjson
from haulbook.operators.validation import compile_schema, payload_errors
from haulbook.plans import intake
from haulbook.schemas import BULK_REQUEST

#: A payload is a name, and nothing else.
NAMED = {"required": ["name"], "properties": {"name": {"type": "string"}}, "additionalProperties": False}


def bulk(spark, *rows):
    return spark.createDataFrame(list(rows), BULK_REQUEST)


def errors(spark, schema, *payloads):
    frame = spark.createDataFrame([(payload,) for payload in payloads], "payload string")
    return [row[0] for row in frame.select(payload_errors(F.col("payload"), schema)).collect()]


MERGES = [
    # defaults, payload, what they make
    ({"from": {"host": "a", "port": 1}}, {"from": {"port": 2}}, {"from": {"host": "a", "port": 2}}),
    ({"from": {"host": "a"}}, {"from": None}, {"from": None}),
    ({"tags": [1, 2, 3]}, {"tags": [9]}, {"tags": [9]}),
    ({"from": {"host": "a"}}, {"from": "b"}, {"from": "b"}),
    ({"from": "b"}, {"from": {"host": "a"}}, {"from": {"host": "a"}}),
    ({"x": {"y": {"z": 0}}}, {}, {"x": {"y": {"z": 0}}}),
    ({}, {"only": True}, {"only": True}),
]


def test_defaults_fill_what_payloads_leave_out(spark, now):
    requests = [
        (f"R{n}", [(json.dumps(payload), None), (json.dumps(payload), 8)], (json.dumps(defaults), n if n % 2 else None))
        for n, (defaults, payload, _) in enumerate(MERGES)
    ]
    taken = intake.submit_bulk(bulk(spark, *requests), now)
    found = sorted((row.request_id, row.priority, row.body) for row in taken.transfers.collect())
    assert [(name, priority, json.loads(body)) for name, priority, body in found] == [
        (f"R{n}", priority, whole) for n, (_, _, whole) in enumerate(MERGES) for priority in (n if n % 2 else 0, 8)
    ]


def test_new_rows(spark, now):
    taken = intake.submit_bulk(bulk(spark, ("R", [('{"a":1}', None)], None), ("empty", [], None)), now)
    row = taken.transfers.first()
    assert (row.request_id, row.status, row.body, row.steps_run, row.priority) == ("R", "pending", '{"a":1}', -1, 0)
    assert (row.submitted_at, row.updated_at, row.info) == (None, None, None)
    assert {tuple(r) for r in taken.requests.collect()} == {("R", at(9000)), ("empty", at(9000))}
    assert {tuple(r) for r in taken.acks.collect()} == {("R", 1), ("empty", 0)}
    again = intake.submit_bulk(bulk(spark, ("R", [('{"a":1}', None)], None)), now)
    assert again.transfers.first().id == row.id


def test_one_bad_payload_rejects_its_request(spark, now, tmp_path):
    good, bad = ('{"name":"b"}', None), ('{"name":7,"x":1}', None)
    requests = bulk(spark, ("R1", [good, bad, good], None), ("R2", [good], None))
    for staging in (None, f"{tmp_path}/staging"):
        taken = intake.submit_bulk(requests, now, NAMED, staging)
        assert {row.request_id for row in taken.transfers.collect()} == {"R2"}
        assert [row.id for row in taken.requests.collect()] == ["R2"]
        assert [tuple(row) for row in taken.rejected.collect()] == [
            ("R1", 1, ["$: unexpected x", "$.name: expected string, found integer"], "invalid")
        ]


def test_payload_is_checked_after_the_merge(spark, now):
    taken = intake.submit_bulk(bulk(spark, ("R", [("{}", None)], ('{"name":"b"}', None))), now, NAMED)
    assert taken.transfers.count() == 1 and taken.rejected.count() == 0


@pytest.mark.parametrize(
    "schema,fine,wrong",
    [
        ({"type": "string"}, ['"x"', '""'], [("1", "expected string, found integer"), ("null", "expected string, found null")]),
        ({"type": "integer"}, ["3", "-98765432109876543210"], [("0.25", "expected integer, found number")]),
        ({"type": "number"}, ["3", "0.25"], [('"3"', "expected number, found string")]),
        ({"type": "boolean"}, ["false"], [("0", "expected boolean, found integer")]),
        ({"type": "object"}, ["{}"], [("[]", "expected object, found array"), ("{", "not JSON"), ("", "not JSON")]),
        ({"type": "array"}, ["[]"], [("{}", "expected array, found object")]),
        ({"type": "null"}, ["null"], [("{}", "expected null, found object")]),
        ({"required": ["a", "b"]}, ['{"a":null,"b":0}', "7"], [('{"b":1}', "missing a")]),
        ({"pattern": "^/.*[.]bam$"}, ['"/x/y.bam"', "1"], [('"/x/y.bai"', "does not match ^/.*[.]bam$")]),
        ({"pattern": "o"}, ['"pot"'], [('"pat"', "does not match o")]),
        ({"additionalProperties": False, "properties": {"a": {}}}, ['{"a":1}', "{}"], [('{"a":1,"c":2}', "unexpected c")]),
    ],
)
def test_keywords_one_by_one(spark, schema, fine, wrong):
    assert errors(spark, schema, *fine) == [[]] * len(fine)
    assert errors(spark, schema, *(payload for payload, _ in wrong)) == [[f"$: {text}"] for _, text in wrong]


def test_errors_of_nested_properties_name_their_paths(spark):
    port = {"properties": {"port": {"type": "integer"}}, "required": ["host"], "additionalProperties": False}
    schema = {"type": "object", "properties": {"from": port, "to": port}, "additionalProperties": False}
    found = errors(spark, schema, '{"from":{"host":1,"port":"x"},"to":{"zone":1,"area":2},"via":0}')
    assert found == [[
        "$: unexpected via", "$.from: unexpected host", "$.from.port: expected integer, found string",
        "$.to: missing host", "$.to: unexpected area", "$.to: unexpected zone",
    ]]


def test_several_types(spark):
    schema = {"$schema": "http://json-schema.org/draft-07/schema", "type": ["object", "boolean"]}
    assert errors(spark, schema, "{}", "true", "1") == [[], [], ["$: expected object or boolean, found integer"]]


def test_unknown_keywords_are_refused():
    with pytest.raises(ValueError, match="multipleOf"):
        compile_schema({"properties": {"a": {"items": {"multipleOf": 3}}}})


def test_values_and_arrays(spark):
    schema = {
        "properties": {
            "kind": {"enum": ["a", 1.0, None]},
            "version": {"const": 2},
            "share": {"minimum": 0, "maximum": 0.5},
            "name": {"minLength": 2, "maxLength": 3},
            "tags": {"items": {"type": "string", "maxLength": 1}, "minItems": 1, "maxItems": 3},
        }
    }
    good = '{"kind":1,"version":2,"share":0.5,"name":"\u00e9\u00e9","tags":["x","y"]}'
    other = '{"kind":null,"share":"9","name":7,"tags":"none"}'
    bad = '{"kind":"b","version":3,"share":0.75,"name":"long","tags":["xx","yy",1,"z"]}'
    few = '{"share":-1,"name":"n","tags":[]}'
    assert errors(spark, schema, good, other, bad, few) == [
        [],
        [],
        [
            '$.kind: not one of "a", 1, null', "$.version: not one of 2", "$.share: more than 0.5", "$.name: longer than 3",
            "$.tags: more than 3 items", "$.tags[]: longer than 1", "$.tags[]: expected string, found integer",
        ],
        ["$.share: less than 0", "$.name: shorter than 2", "$.tags: fewer than 1 items"],
    ]


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text(alphabet="ab", max_size=2),
    lambda inner: st.lists(inner, max_size=2) | st.dictionaries(st.sampled_from("abc"), inner, max_size=3),
    max_leaves=8,
)
PAYLOAD = st.dictionaries(st.sampled_from("abc"), JSON, max_size=3)


def merged(below, above):
    if isinstance(below, dict) and isinstance(above, dict):
        return {
            key: merged(below[key], above[key]) if key in below and key in above else {**below, **above}[key]
            for key in {**below, **above}
        }
    return above


@settings(max_examples=4, deadline=None)
@given(pairs=st.lists(st.tuples(PAYLOAD, PAYLOAD), min_size=20, max_size=40))
def test_deep_merge_of_any_json(spark, pairs):
    rows = [(json.dumps(below), json.dumps(above)) for below, above in pairs]
    frame = spark.createDataFrame(rows, "d string, p string").coalesce(1)
    found = frame.select(fjson.deep_merge(F.col("d"), F.col("p")).alias("merged")).collect()
    for (below, above), row in zip(pairs, found):
        assert json.loads(row.merged) == merged(below, above)


def nested(levels):
    deep, other = 1, 2
    for _ in range(levels):
        deep, other = {"a": deep, "x": 1}, {"a": other, "y": 2}
    return deep, other


def test_deep_defaults_are_merged_and_too_deep_ones_refused(spark, now):
    deep, other = nested(12)
    taken = intake.submit_bulk(bulk(spark, ("R", [(json.dumps(other), None)], (json.dumps(deep), None))), now)
    assert json.loads(taken.transfers.first().body) == merged(deep, other)
    deep, other = nested(fjson.MAX_MERGE_DEPTH + 1)
    with pytest.raises(ValueError, match="objects deep"):
        intake.submit_bulk(bulk(spark, ("R", [(json.dumps(other), None)], (json.dumps(deep), None))), now)


def test_merged_numbers_do_not_depend_on_other_rows(spark, now):
    item, defaults = ('{"b":1.0,"f":1e-7,"n":12345678901234567,"t":"}{"}', None), ('{"a":"{{{"}', None)
    alone = intake.submit_bulk(bulk(spark, ("R", [item], defaults)), now)
    deep = json.dumps(nested(9)[0])
    beside = intake.submit_bulk(bulk(spark, ("R", [item], defaults), ("S", [item], (deep, None))), now)
    text = '{"a":"{{{","b":1,"f":1.0E-7,"n":12345678901234567,"t":"}{"}'
    assert alone.transfers.first().body == text
    assert beside.transfers.where("request_id = 'R'").first().body == text


def test_nesting_of_texts(spark):
    texts = ['{"a":{"b":{}}}', '[{},{},{"a":{}}]', '{"a":"{{{\\"{"}', "3", None]
    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    assert [row[0] for row in frame.select(fjson.nesting_of_text(F.col("t"))).collect()] == [3, 2, 1, 0, None]
