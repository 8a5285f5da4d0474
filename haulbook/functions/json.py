"""JSON payloads as variants: message tuples and the deep merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulbook.schemas import SIGNAL_STATUS

#: Deepest nesting of defaults that is merged; deeper ones are refused.
MAX_MERGE_DEPTH = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def tuple_item(message: Column, index: int, as_type: str) -> Column:
    """An element of a JSON array held as a variant."""
    return F.variant_get(message, f"$[{index}]", as_type)


def tuple_json(message: Column, index: int) -> Column:
    return F.to_json(F.variant_get(message, f"$[{index}]", "variant"))


def as_tuple(first: Column, info: Column) -> Column:
    """JSON text ``[first, info]``; ``first`` is a number or a string, ``info`` JSON text."""
    head = F.to_json(F.array(first))
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), info, F.lit("]"))


def status_of_signal(signal: Column) -> Column:
    """State a result signal leads to; an unknown signal fails the job."""
    ladder = None
    for name, status in SIGNAL_STATUS.items():
        ladder = F.when(signal == name, status) if ladder is None else ladder.when(signal == name, status)
    return ladder.otherwise(F.raise_error(F.concat(F.lit("unknown result signal: "), signal)).cast("string"))


def _as_object(value: Column) -> Column:
    """The fields of a JSON object; null for scalars and arrays."""
    return value.try_cast("map<string,variant>")


def _merge_variants(below: Column, above: Column, depth: int) -> Column:
    if depth == 0:
        return above
    fields = F.map_zip_with(
        _as_object(below),
        _as_object(above),
        lambda _, low, high: F.when(high.isNull(), low)
        .when(low.isNull(), high)
        .otherwise(_merge_variants(low, high, depth - 1)),
    )
    # The fields are null unless both sides are objects; anything else is replaced, also by an explicit null.
    return F.coalesce(F.to_variant_object(fields), above)


def deep_merge(defaults: Column, payload: Column, depth: int = MAX_MERGE_DEPTH) -> Column:
    """Merge JSON texts: objects merge key by key down to ``depth``, otherwise ``payload`` wins.

    ``depth`` must be at least the nesting depth of ``defaults``, which `nesting_of_text` gives. Merged texts have their keys
    in order and their numbers as Spark's variants write them (1.0 as 1, 1e-7 as 1.0E-7), whatever other rows hold; payloads
    without defaults stay as they came.
    """
    merged = let(F.parse_json(payload), lambda above: _merge_variants(F.parse_json(defaults), above, depth))
    return F.when(defaults.isNull(), payload).otherwise(F.to_json(merged))


def nesting_of_text(text: Column) -> Column:
    """How deep objects nest in a JSON text; braces inside strings do not count."""
    braces = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), "[^{}]", "")
    step = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(so_far: Column, brace: Column) -> Column:
        now = so_far["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(so_far["most"], now).alias("most"))

    return F.aggregate(F.split(braces, ""), step, count, lambda so_far: so_far["most"])
