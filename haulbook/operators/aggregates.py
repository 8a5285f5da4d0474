"""Counts, summaries and the latest message per transfer.

All of these aggregate partially before they shuffle, so a hot request or transfer costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.schemas import STATUSES


def count_requests(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count(F.lit(1)).alias("n"))


def count_transfers(transfers: DataFrame, status: str | None = None) -> DataFrame:
    """Transfers per request, in all states or in one."""
    if status is not None:
        transfers = transfers.where(F.col("status") == status)
    return transfers.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


def count_by_status(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def request_status_counts(transfers: DataFrame, requests: DataFrame) -> DataFrame:
    """Transfers per known request and state."""
    counts = transfers.groupBy("request_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumnRenamed("request_id", "id").join(requests.select("id"), "id")


def status_columns() -> list[Column]:
    """One count per state, zero where a group has none."""
    return [F.count_if(F.col("status") == status).alias(status) for status in STATUSES]


def status_map() -> Column:
    """The six count columns as a map from state to count."""
    return F.create_map(*[item for status in STATUSES for item in (F.lit(status), F.col(status))])


def request_status_map(transfers: DataFrame) -> DataFrame:
    """Per request, a map with the count of every state."""
    counts = transfers.groupBy("request_id").agg(*status_columns())
    return counts.select("request_id", status_map().alias("status_counts"))


def request_times(transfers: DataFrame) -> DataFrame:
    """First submission and last update per request; null if there was none."""
    return transfers.groupBy("request_id").agg(
        F.min("submitted_at").alias("submitted_at"), F.max("updated_at").alias("updated_at")
    )


def summaries(transfers: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request that has transfers: arrival, a count per state, first submission, last update.

    Transfers are reduced to one row per request before the join, so only requests are shuffled for it.
    """
    reduced = transfers.groupBy(F.col("request_id").alias("id")).agg(
        *status_columns(), F.min("submitted_at").alias("submitted_at"), F.max("updated_at").alias("updated_at")
    )
    return requests.join(reduced, "id").select("id", "received_at", *STATUSES, "submitted_at", "updated_at")


def latest_progress(progress: DataFrame) -> DataFrame:
    """Per (request, transfer), the message of the highest step; the first to arrive among equals."""
    order = F.struct("step", -F.col("arrival"), "info")
    return progress.groupBy("request_id", "transfer_id").agg(
        F.max("step").alias("step"), F.max_by("info", order).alias("info")
    )


def last_results(results: DataFrame) -> DataFrame:
    """Per (request, transfer), the last result in arrival order, and how many there were."""
    last = F.max_by(F.struct("signal", "info", "arrival"), F.struct("arrival", "signal", "info"))
    return (
        results.groupBy("request_id", "transfer_id")
        .agg(last.alias("last"), F.count(F.lit(1)).alias("n_results"))
        .select("request_id", "transfer_id", "last.signal", "last.info", "last.arrival", "n_results")
    )


def acknowledge(changed: DataFrame) -> DataFrame:
    """Changed rows per request."""
    return changed.groupBy("request_id").agg(F.count(F.lit(1)).alias("updated_count"))
