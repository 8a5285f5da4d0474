"""Payload checks compiled from a JSON schema to one column of error texts."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulbook.functions.json import let

#: Keywords that say something about a payload.
CHECKED = (
    "type", "properties", "required", "additionalProperties", "pattern", "enum", "const", "minimum", "maximum",
    "minLength", "maxLength", "items", "minItems", "maxItems",
)
#: Keywords that describe the schema itself.
IGNORED = ("$schema", "$id", "id", "title", "description", "default", "examples", "$comment")


def compile_schema(schema: Mapping | str) -> Mapping:
    """Check that every keyword is one we can enforce; a schema we would half-ignore is an error."""
    if isinstance(schema, str):
        schema = json.loads(schema)
    for keyword in schema:
        if keyword not in CHECKED + IGNORED:
            raise ValueError(f"unsupported schema keyword: {keyword}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties must be true or false")
    for nested in schema.get("properties", {}).values():
        compile_schema(nested)
    if "items" in schema:
        if not isinstance(schema["items"], Mapping):
            raise ValueError("items must be one schema")
        compile_schema(schema["items"])
    return schema


# What a variant reports as its type, for each JSON type.
VARIANT_TYPES = {
    "null": r"VOID",
    "boolean": r"BOOLEAN",
    "string": r"STRING",
    # A decimal without fraction is an integer too long for a bigint, or one written as 1.0.
    "integer": r"BIGINT|DECIMAL\(\d+,0\)",
    "number": r"BIGINT|DECIMAL.*|DOUBLE|FLOAT",
    "array": r"ARRAY<.*",
    "object": r"OBJECT<.*",
}
# The most frequent spelling of each type, compared before any pattern.
PLAIN_TYPES = {"null": "VOID", "boolean": "BOOLEAN", "string": "STRING", "integer": "BIGINT", "number": "BIGINT"}


def json_type(reported: Column) -> Column:
    """JSON type name of what a variant reports as its type."""
    ladder = F
    for name, pattern in VARIANT_TYPES.items():
        ladder = ladder.when(reported.rlike(f"^({pattern})$"), name)
    return ladder


def _is_type(value: Column, reported: Column, name: str) -> Column:
    if name == "object":
        return value.try_cast("map<string,variant>").isNotNull()
    if name == "array":
        return value.try_cast("array<variant>").isNotNull()
    plain = reported == PLAIN_TYPES[name]
    return plain if name not in ("integer", "number") else plain | reported.rlike(f"^({VARIANT_TYPES[name]})$")


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _single(condition: Column, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(condition, F.array(text)).otherwise(_no_errors())


def _joined(checks: list[Column]) -> Column:
    return F.concat(*checks) if checks else _no_errors()


def _errors(value: Column, schema: Mapping, path: str) -> Column:
    """Error list of a value that is present."""
    checks = []
    if "type" in schema:
        checks.append(_type_errors(value, schema["type"], path))
    if "pattern" in schema:
        # Null, and so no error, unless the value is a string.
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        checks.append(_single(~text.rlike(schema["pattern"]), f"{path}: does not match {schema['pattern']}"))
    checks += _value_errors(value, schema, path)
    if any(keyword in schema for keyword in ("items", "minItems", "maxItems")):
        elements = value.try_cast("array<variant>")
        checks.append(let(elements, lambda found: _array_errors(found, schema, path)))
    if any(keyword in schema for keyword in ("required", "properties", "additionalProperties")):
        fields = value.try_cast("map<string,variant>")
        checks.append(let(fields, lambda found: _object_errors(found, schema, path)))
    return _joined(checks)


def _written(value: object) -> str:
    """A value of the schema as the text that a variant becomes."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _value_errors(value: Column, schema: Mapping, path: str) -> list[Column]:
    """Errors of single values; keywords for another type than the value's say nothing."""
    checks = []
    allowed = [schema["const"]] if "const" in schema else schema.get("enum")
    if allowed is not None:
        texts = [_written(item) for item in allowed]
        checks.append(_single(~F.to_json(value).isin(texts), f"{path}: not one of {', '.join(texts)}"))
    reported = F.schema_of_variant(value)
    number = F.when(_is_type(value, reported, "number"), F.try_variant_get(value, "$", "double"))
    length = F.length(F.when(reported == "STRING", F.try_variant_get(value, "$", "string")))
    for keyword, fails, text in (
        ("minimum", lambda bound: number < bound, "less than"),
        ("maximum", lambda bound: number > bound, "more than"),
        ("minLength", lambda bound: length < bound, "shorter than"),
        ("maxLength", lambda bound: length > bound, "longer than"),
    ):
        if keyword in schema:
            checks.append(_single(fails(F.lit(schema[keyword])), f"{path}: {text} {schema[keyword]}"))
    return checks


def _array_errors(elements: Column, schema: Mapping, path: str) -> Column:
    """Errors about an array, each once whatever number of elements has it; none for a value that is not an array."""
    checks = []
    if "minItems" in schema:
        checks.append(_single(F.size(elements) < schema["minItems"], f"{path}: fewer than {schema['minItems']} items"))
    if "maxItems" in schema:
        checks.append(_single(F.size(elements) > schema["maxItems"], f"{path}: more than {schema['maxItems']} items"))
    if schema.get("items"):
        each = F.transform(elements, lambda element: _errors(element, schema["items"], f"{path}[]"))
        checks.append(F.array_distinct(F.flatten(each)))
    return F.when(elements.isNull(), _no_errors()).otherwise(_joined(checks))


def _type_errors(value: Column, types: str | list[str], path: str) -> Column:
    types = [types] if isinstance(types, str) else list(types)
    reported = F.schema_of_variant(value)
    accepted = reduce(Column.__or__, [_is_type(value, reported, name) for name in types])
    # The type is only named for a value that is not accepted.
    text = F.concat(F.lit(f"{path}: expected {' or '.join(types)}, found "), json_type(reported))
    return _single(~accepted, text)


def _object_errors(fields: Column, schema: Mapping, path: str) -> Column:
    """Errors about the fields of an object; none for a value that is not an object."""
    checks = [
        _single(~F.map_contains_key(fields, name), f"{path}: missing {name}") for name in schema.get("required", [])
    ]
    properties = schema.get("properties", {})
    if schema.get("additionalProperties", True) is False:
        known = F.array(*[F.lit(name) for name in properties]).cast("array<string>")
        unknown = F.array_sort(F.array_except(F.map_keys(fields), known))
        texts = F.transform(unknown, lambda name: F.concat(F.lit(f"{path}: unexpected "), name))
        n_known = sum(F.map_contains_key(fields, name).cast("int") for name in properties) if properties else F.lit(0)
        # Counting known fields tells the usual case without building sets.
        checks.append(F.when(F.size(fields) > n_known, texts).otherwise(_no_errors()))
    for name, nested in properties.items():
        checks.append(let(fields[name], partial(_property_errors, schema=nested, path=f"{path}.{name}")))
    return F.when(fields.isNull(), _no_errors()).otherwise(_joined(checks))


def _property_errors(value: Column, schema: Mapping, path: str) -> Column:
    return F.when(value.isNull(), _no_errors()).otherwise(_errors(value, schema, path))


def payload_errors(payload: Column, schema: Mapping | str) -> Column:
    """All that is wrong with a JSON text; an empty array if nothing is."""
    schema = compile_schema(schema)

    def check(value: Column) -> Column:
        return F.when(value.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_errors(value, schema, "$"))

    return let(F.try_parse_json(payload), check)
