"""Intake of bulk requests: merge defaults, validate, and turn into ledger rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.functions.ids import transfer_id
from haulbook.functions.json import MAX_MERGE_DEPTH, deep_merge, nesting_of_text
from haulbook.operators.validation import payload_errors
from haulbook.plans.control import INVALID
from haulbook.schemas import DEFAULT_PRIORITY, NEW_STEPS, TRANSFER_COLUMNS

ITEMS = ["request_id", "ordinal", "payload", "priority", "default_payload", "default_priority"]


@dataclass(frozen=True)
class Intake:
    """Ledger rows of the accepted requests, a count per request, and what was wrong with the others."""

    requests: DataFrame
    transfers: DataFrame
    acks: DataFrame
    rejected: DataFrame


def items_of(bulk: DataFrame) -> DataFrame:
    """A row per transfer of bulk requests (request_id, transfers, defaults), next to its request's defaults."""
    return bulk.select(
        "request_id",
        F.posexplode("transfers").alias("ordinal", "transfer"),
        F.col("defaults.payload").alias("default_payload"),
        F.col("defaults.priority").alias("default_priority"),
    ).select(
        "request_id",
        "ordinal",
        F.col("transfer.payload").alias("payload"),
        F.col("transfer.priority").alias("priority"),
        "default_payload",
        "default_priority",
    )


def items_with_defaults(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """The same from a flat frame (request_id, ordinal, payload, priority) and one of defaults per request.

    For requests whose transfers would not fit one row.
    """
    own = defaults.select(
        "request_id", F.col("payload").alias("default_payload"), F.col("priority").alias("default_priority")
    )
    return rows.join(own, "request_id", "left").select(*ITEMS)


def nesting_of(rows: DataFrame, defaults: str) -> int:
    """How deep a column of defaults nests: one number, from a scan of that column alone."""
    return rows.select(F.max(nesting_of_text(F.col(defaults)))).first()[0] or 0


def merge_defaults(items: DataFrame, depth: int | None = None) -> DataFrame:
    """Payloads with their defaults filled in, and the priority that applies.

    ``depth`` bounds the nesting of the defaults, and is looked up if not given; built-in expressions merge down to it.
    """
    if depth is None:
        depth = nesting_of(items, "default_payload")
    if depth > MAX_MERGE_DEPTH:
        raise ValueError(f"defaults nest {depth} objects deep; at most {MAX_MERGE_DEPTH} are merged")
    merged = deep_merge(F.col("default_payload"), F.col("payload"), depth)
    return items.select(
        "request_id",
        "ordinal",
        merged.alias("payload"),
        F.coalesce("priority", "default_priority", F.lit(DEFAULT_PRIORITY)).cast("smallint").alias("priority"),
    )


def validate(items: DataFrame, schema: Mapping | str) -> DataFrame:
    """Merged items with the list of errors in each payload."""
    return items.withColumn("errors", payload_errors(F.col("payload"), schema))


def invalid_requests(validated: DataFrame) -> DataFrame:
    """Requests with at least one bad payload; they are rejected as a whole."""
    return validated.where(F.size("errors") > 0).select("request_id").distinct()


def new_requests(ids: DataFrame, now: Column) -> DataFrame:
    return ids.select(F.col("request_id").alias("id"), now.alias("received_at"))


def new_transfers(items: DataFrame) -> DataFrame:
    """Merged items as pending ledger rows."""
    nothing = F.lit(None)
    return items.select(
        transfer_id(F.col("request_id"), F.col("ordinal")).alias("id"),
        "request_id",
        F.lit("pending").alias("status"),
        F.col("payload").alias("body"),
        nothing.cast("timestamp_ntz").alias("submitted_at"),
        nothing.cast("timestamp_ntz").alias("updated_at"),
        nothing.cast("string").alias("info"),
        F.lit(NEW_STEPS).alias("steps_run"),
        "priority",
    ).select(*TRANSFER_COLUMNS)


def submit(
    request_ids: DataFrame,
    items: DataFrame,
    now: Column,
    schema: Mapping | str | None = None,
    depth: int | None = None,
    staging: str | None = None,
) -> Intake:
    """Take in requests: ``request_ids`` names them (one may be empty), ``items`` are their transfers.

    Without a schema every payload is accepted. With a ``staging`` folder the merged and validated items are written
    there once, and the four results read what they need of them instead of merging again.
    """
    merged = merge_defaults(items, depth)
    if schema is not None:
        merged = validate(merged, schema)
    if staging is not None:
        merged.write.mode("overwrite").parquet(staging)
        merged = merged.sparkSession.read.schema(merged.schema).parquet(staging)
    ids = request_ids.select("request_id")
    if schema is None:
        rejected = merged.where(F.lit(False)).select(
            "request_id", "ordinal", F.array().cast("array<string>").alias("errors"), F.lit(INVALID).alias("reason")
        )
    else:
        bad = invalid_requests(merged)
        rejected = merged.where(F.size("errors") > 0).select(
            "request_id", "ordinal", "errors", F.lit(INVALID).alias("reason")
        )
        merged = merged.join(bad, "request_id", "left_anti")
        ids = ids.join(bad, "request_id", "left_anti")
    counts = merged.groupBy("request_id").agg(F.count(F.lit(1)).alias("updated_count"))
    acks = ids.join(counts, "request_id", "left").fillna(0, ["updated_count"])
    return Intake(new_requests(ids, now), new_transfers(merged), acks, rejected)


def submit_bulk(
    bulk: DataFrame, now: Column, schema: Mapping | str | None = None, staging: str | None = None
) -> Intake:
    """Take in bulk requests with one row each."""
    return submit(bulk, items_of(bulk), now, schema, nesting_of(bulk, "defaults.payload"), staging)
