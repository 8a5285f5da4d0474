"""Reconsider and re-prioritise, for one target or for a frame of a million.

Every call takes the targets as a frame with unique keys and returns the new images of the rows it changes, a count per
target that was found (zero is legal), and the targets it could not serve with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.operators.joins import existing, missing, reduced
from haulbook.schemas import RECONSIDERED_STEPS, TRANSFER_COLUMNS

NOT_FOUND = "not_found"
CONFLICT = "conflict"
INVALID = "invalid"

REQUEST = ["request_id"]
TRANSFER = ["request_id", "id"]


@dataclass(frozen=True)
class Outcome:
    changed: DataFrame
    acks: DataFrame
    rejected: DataFrame


def reconsider_requests(transfers: DataFrame, requests: DataFrame, targets: DataFrame) -> Outcome:
    """Failed transfers of whole requests become pending again."""
    known = requests.select(F.col("id").alias("request_id"))
    found = existing(targets.select(*REQUEST), known, REQUEST)
    changed = _reconsider(transfers.join(found, REQUEST, "left_semi"))
    return Outcome(changed, _acks(found, changed, REQUEST), _rejected(missing(targets, known, REQUEST), NOT_FOUND))


def reconsider_transfers(transfers: DataFrame, targets: DataFrame) -> Outcome:
    """Single failed transfers become pending again; one that did not fail stays as it is."""
    transfers = reduced(transfers, targets, TRANSFER)
    found = existing(targets.select(*TRANSFER), transfers, TRANSFER)
    changed = _reconsider(transfers.join(targets.select(*TRANSFER), TRANSFER, "left_semi"))
    return Outcome(
        changed, _acks(found, changed, TRANSFER), _rejected(missing(targets, transfers, TRANSFER), NOT_FOUND)
    )


def prioritise_requests(transfers: DataFrame, requests: DataFrame, targets: DataFrame) -> Outcome:
    """Set the priority of all pending transfers of requests; a request without pending ones is a conflict."""
    known = requests.select(F.col("id").alias("request_id"))
    wanted = targets.select("request_id", F.col("priority").cast("smallint").alias("new_priority"))
    pending = transfers.where(F.col("status") == "pending").join(wanted, REQUEST)
    # One row per request that has pending transfers, so the split below needs no second look at them.
    counts = pending.groupBy("request_id").agg(F.count_if(_differs()).alias("updated_count"))
    conflicts = existing(missing(targets, counts, REQUEST), known, REQUEST)
    unknown = missing(targets, known, REQUEST)
    rejected = _rejected(unknown, NOT_FOUND).unionByName(_rejected(conflicts, CONFLICT))
    return Outcome(_prioritise(pending), existing(counts, known, REQUEST), rejected)


def prioritise_transfers(transfers: DataFrame, targets: DataFrame) -> Outcome:
    """The same for single transfers; one that is not pending is a conflict."""
    wanted = targets.select(*TRANSFER, F.col("priority").cast("smallint").alias("new_priority"))
    transfers = reduced(transfers, targets, TRANSFER)
    found = transfers.join(wanted, TRANSFER)
    pending = found.where(F.col("status") == "pending")
    acks = pending.select(*TRANSFER, _differs().cast("bigint").alias("updated_count"))
    conflicts = found.where(F.col("status") != "pending")
    rejected = _rejected(missing(targets, transfers, TRANSFER), NOT_FOUND, TRANSFER).unionByName(
        _rejected(conflicts, CONFLICT, TRANSFER)
    )
    return Outcome(_prioritise(pending), acks, rejected)


def _reconsider(transfers: DataFrame) -> DataFrame:
    return (
        transfers.where(F.col("status") == "failed")
        .withColumns({"status": F.lit("pending"), "steps_run": F.lit(RECONSIDERED_STEPS)})
        .select(*TRANSFER_COLUMNS)
    )


def _differs() -> Column:
    return F.col("priority") != F.col("new_priority")


def _prioritise(pending: DataFrame) -> DataFrame:
    return pending.where(_differs()).withColumn("priority", F.col("new_priority")).select(*TRANSFER_COLUMNS)


def _acks(found: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    counts = changed.groupBy(*keys).agg(F.count(F.lit(1)).alias("updated_count"))
    return found.join(counts, keys, "left").fillna(0, ["updated_count"])


def _rejected(targets: DataFrame, reason: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or [name for name in TRANSFER if name in targets.columns]
    return targets.select(*keys, F.lit(reason).alias("reason"))
