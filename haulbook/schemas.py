"""Tables, enumerations and message records."""

from __future__ import annotations

from pyspark.sql import types as T

# The states a transfer can be in, in their declared order.
STATUSES = ("pending", "submitted", "inprogress", "failed", "succeeded", "expanded")
# States counted against the in-flight cap; only they accept progress.
IN_FLIGHT = ("submitted", "inprogress")
#: States that only a control message leads out of.
ENDED = ("failed", "succeeded", "expanded")
# What a result message reports, and the state it leads to.
SIGNAL_STATUS = {"SUCCESS": "succeeded", "FATAL_FAILURE": "failed", "EXPANDED": "expanded"}

# A new transfer has run no step yet; a reconsidered one starts over at 0.
NEW_STEPS = -1
RECONSIDERED_STEPS = 0
DEFAULT_PRIORITY = 0

REQUESTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
    ]
)

TRANSFERS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("submitted_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("info", T.StringType()),
        T.StructField("steps_run", T.IntegerType()),
        T.StructField("priority", T.ShortType()),
    ]
)

TRANSFER_COLUMNS = TRANSFERS.fieldNames()

#: One transfer of a bulk request; the request's defaults have the same shape.
TRANSFER_REQUEST = T.StructType(
    [
        T.StructField("payload", T.StringType()),
        T.StructField("priority", T.ShortType()),
    ]
)

#: Bulk requests, one row each, keyed by the id the sender (or `with_request_ids`) gave it.
BULK_REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("transfers", T.ArrayType(TRANSFER_REQUEST)),
        T.StructField("defaults", TRANSFER_REQUEST),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("transfer_id", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("info", T.StringType()),
        T.StructField("arrival", T.LongType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("transfer_id", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("info", T.StringType()),
        T.StructField("arrival", T.LongType()),
    ]
)

#: The message envelope on every topic; `message` is the payload, `[step, info]` or `[signal, info]`.
ENVELOPE_DDL = "ids struct<request:string,transfer:string>, message variant"
