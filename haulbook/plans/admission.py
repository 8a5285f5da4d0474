"""Admission: pending transfers submitted by priority while the in-flight cap leaves room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.operators.ranking import Key, cut_at
from haulbook.schemas import IN_FLIGHT, TRANSFER_COLUMNS

#: Time between sweeps, unless configured otherwise.
SWEEP_INTERVAL = "3 seconds"


def slots(transfers: DataFrame, max_in_flight: int) -> int:
    """How many more transfers may be submitted; never negative."""
    in_flight = transfers.where(F.col("status").isin(*IN_FLIGHT)).count()
    return max(0, max_in_flight - in_flight)


def next_pending(transfers: DataFrame, requests: DataFrame, count: int) -> DataFrame:
    """The first ``count`` pending transfers by priority (highest first), arrival of their request, and id.

    Nothing is sorted. The lowest priority that still gets in is found from counts per priority; only rows of that
    priority need the arrival of their request, first as counts per request; and only those of the last admitted arrival
    time are told apart by id. A request that owns most pending rows is one counted row until the last step.
    """
    pending = transfers.where(F.col("status") == "pending")
    if count <= 0:
        return pending.where(F.lit(False))
    by_priority, left = cut_at(pending, [Key("priority", descending=True)], count)
    if by_priority is None:
        return pending
    lowest = by_priority.values[0]
    above = pending.where(F.col("priority") > lowest)
    level = pending.where(F.col("priority") == lowest)

    arrivals = requests.withColumnRenamed("id", "request_id")
    per_request = level.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).join(arrivals, "request_id")
    by_arrival, left = cut_at(per_request, [Key("received_at")], left, weight="n")
    if by_arrival is None:
        return above.unionByName(level)
    latest = by_arrival.values[0]
    candidates = level.select("id", "request_id").join(arrivals.where(F.col("received_at") <= latest), "request_id")
    by_id, _ = cut_at(candidates.where(F.col("received_at") == latest), [Key("id")], left)
    if by_id is not None:
        candidates = candidates.where((F.col("received_at") < latest) | by_id.covers)
    # Only ids went through the shuffle so far; AQE sends them to where the payloads are if it finds them small.
    return above.unionByName(level.join(candidates.select("id"), "id", "left_semi"))


def admit(transfers: DataFrame, requests: DataFrame, max_in_flight: int, now: Column) -> DataFrame:
    """New images of the transfers to submit now; only state and submission time change."""
    chosen = next_pending(transfers, requests, slots(transfers, max_in_flight))
    return chosen.withColumns({"status": F.lit("submitted"), "submitted_at": now}).select(*TRANSFER_COLUMNS)
