"""Progress and result messages folded into the ledger.

Messages are reduced to one row per (request, transfer) before they meet the ledger, so a transfer that most messages
are about joins as a single row. `apply_messages` folds both kinds with one aggregation and one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.functions.ids import child_id
from haulbook.functions.json import status_of_signal
from haulbook.operators.aggregates import last_results, latest_progress
from haulbook.operators.filters import accepts_progress
from haulbook.operators.joins import parent_priority, update_from_messages
from haulbook.schemas import IN_FLIGHT, NEW_STEPS, TRANSFER_COLUMNS


def apply_progress(transfers: DataFrame, progress: DataFrame, now: Column) -> DataFrame:
    """New images of the in-flight transfers that got to a later step."""
    latest = latest_progress(progress).withColumnRenamed("info", "new_info")
    # The cap bounds what is in flight, so filtering first leaves little of the ledger to shuffle.
    in_flight = transfers.where(F.col("status").isin(*IN_FLIGHT))
    rows = update_from_messages(in_flight, latest)
    rows = rows.where(accepts_progress(F.col("status"), F.col("steps_run"), F.col("step")))
    return rows.withColumns(
        {"status": F.lit("inprogress"), "updated_at": now, "info": F.col("new_info"), "steps_run": F.col("step")}
    ).select(*TRANSFER_COLUMNS)


def apply_results(transfers: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """New images of the transfers that ended; the last result wins over any state, each one counts as a step."""
    last = last_results(results).withColumnRenamed("info", "new_info")
    rows = update_from_messages(transfers, last)
    return rows.withColumns(
        {
            "status": status_of_signal(F.col("signal")),
            "updated_at": now,
            "info": _result_info(F.col("signal"), F.col("new_info"), F.col("id"), F.col("arrival")),
            "steps_run": (F.col("steps_run") + F.col("n_results")).cast("int"),
        }
    ).select(*TRANSFER_COLUMNS)


def apply_messages(transfers: DataFrame, progress: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Progress, then results, in one pass over both."""
    return fold_tagged(transfers, tag_messages(progress, results), now)


def tag_messages(progress: DataFrame, results: DataFrame) -> DataFrame:
    """Both kinds of messages as one frame: ``signal`` is null in progress messages, ``step`` in results."""
    steps = progress.withColumn("signal", F.lit(None).cast("string"))
    return steps.unionByName(results.withColumn("step", F.lit(None).cast("int")))


def fold_tagged(transfers: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """`apply_progress` followed by `apply_results` over messages tagged by `tag_messages`."""
    return apply_folded(transfers, folded(messages), now)


def folded(messages: DataFrame) -> DataFrame:
    """Tagged messages as one row per (request, transfer)."""
    is_step, is_end = F.col("signal").isNull(), F.col("signal").isNotNull()
    step_order = F.when(is_step, F.struct("step", -F.col("arrival"), "info"))
    end_order = F.when(is_end, F.struct("arrival", "signal", "info"))
    return messages.groupBy("request_id", "transfer_id").agg(
        F.max("step").alias("step"),
        F.max_by("info", step_order).alias("step_info"),
        F.max_by(F.struct("signal", "info", "arrival"), end_order).alias("last"),
        F.count_if(is_end).alias("n_results"),
    )


def apply_folded(transfers: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """New images of the transfers that messages, one row for each by `folded`, change."""
    rows = update_from_messages(transfers, messages)
    moved = F.coalesce(accepts_progress(F.col("status"), F.col("steps_run"), F.col("step")), F.lit(False))
    ended = F.col("n_results") > 0
    steps = F.when(moved, F.col("step")).otherwise(F.col("steps_run")) + F.col("n_results")
    info = _result_info(F.col("last.signal"), F.col("last.info"), F.col("id"), F.col("last.arrival"))
    return (
        rows.where(moved | ended)
        .withColumns(
            {
                "status": F.when(ended, status_of_signal(F.col("last.signal"))).otherwise("inprogress"),
                "updated_at": now,
                "info": F.when(ended, info).otherwise(F.col("step_info")),
                "steps_run": steps.cast("int"),
            }
        )
        .select(*TRANSFER_COLUMNS)
    )


def payload_list(info: Column) -> Column:
    """The payloads an EXPANDED result carries; fails if it does not carry a list."""
    return F.variant_get(F.parse_json(info), "$", "array<variant>")


def expanded_ids(parent_id: Column, arrival: Column, info: Column) -> Column:
    """Ids of the children of an EXPANDED result, in order, without unrolling them."""
    return F.transform(payload_list(info), lambda _, position: child_id(parent_id, arrival, position))


def _result_info(signal: Column, info: Column, parent_id: Column, arrival: Column) -> Column:
    children = F.to_json(F.struct(expanded_ids(parent_id, arrival, info).alias("expandedTo")))
    return F.when(signal == "EXPANDED", children).otherwise(info)


@dataclass(frozen=True)
class Expansion:
    """Children to insert, and EXPANDED results that name a transfer or request the ledger does not know."""

    children: DataFrame
    rejected: DataFrame


def expand(transfers: DataFrame, results: DataFrame, requests: DataFrame, strict: bool = True) -> Expansion:
    """A pending transfer per payload of every EXPANDED result, with the priority of the transfer it came from.

    Ids derive from the message, so a replay inserts nothing new. Children go to the request the message names, as the
    message is the only thing that says where they belong. ``strict`` fails the job on unknown parents or requests.
    """
    expanded = results.where(F.col("signal") == "EXPANDED")
    messages = parent_priority(expanded, transfers)
    known = requests.select(F.col("id").alias("request_id"), F.lit(True).alias("is_request"))
    # Only messages whose request is not the parent's need the requests table.
    same = F.col("parent_request_id") == F.col("request_id")
    matched = messages.where(same).withColumn("is_request", F.lit(True))
    others = messages.where(~F.coalesce(same, F.lit(False))).join(known, "request_id", "left")
    checked = matched.unionByName(others)
    reason = F.when(F.col("priority").isNull(), "unknown transfer").when(
        F.col("is_request").isNull(), "unknown request"
    )
    checked = checked.withColumn("reason", reason)
    if strict:
        failure = F.raise_error(F.concat(F.col("reason"), F.lit(" in an expansion of "), F.col("transfer_id")))
        accepted = checked.withColumn(
            "priority", F.when(F.col("reason").isNotNull(), failure.cast("smallint")).otherwise(F.col("priority"))
        )
    else:
        accepted = checked.where(F.col("reason").isNull())
    children = accepted.select(
        "request_id",
        "transfer_id",
        "arrival",
        "priority",
        F.posexplode(payload_list(F.col("info"))).alias("position", "payload"),
    ).select(
        child_id(F.col("transfer_id"), F.col("arrival"), F.col("position")).alias("id"),
        "request_id",
        F.lit("pending").alias("status"),
        F.to_json("payload").alias("body"),
        F.lit(None).cast("timestamp_ntz").alias("submitted_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("string").alias("info"),
        F.lit(NEW_STEPS).alias("steps_run"),
        "priority",
    )
    rejected = checked.where(F.col("reason").isNotNull()).select("request_id", "transfer_id", "arrival", "reason")
    return Expansion(children, rejected)
