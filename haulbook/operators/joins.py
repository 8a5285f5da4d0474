"""Equi-joins between the ledger, requests, messages and manifests.

No join here is forced to broadcast: AQE does so from measured sizes, and splits the partitions of hot keys (one request
may own a third of all transfers) when it sorts and merges instead. Sides that are aggregated first are aggregated
before the join, so that a hot key has already shrunk to one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transfers_with_requests(transfers: DataFrame, requests: DataFrame) -> DataFrame:
    """Transfers with the time their request arrived; requests without transfers drop out."""
    times = requests.select(F.col("id").alias("request_id"), "received_at")
    return transfers.join(times, "request_id")


def update_from_batch(transfers: DataFrame, batch: DataFrame) -> DataFrame:
    """Ledger rows of a chosen batch of transfer ids."""
    return transfers.join(batch, "id", "left_semi")


def update_from_messages(transfers: DataFrame, messages: DataFrame) -> DataFrame:
    """Ledger rows with the message addressed to them; both the transfer and the request id must match.

    Transfer ids are unique, so they alone are the join key, which is also what snapshots are bucketed by; comparing
    requests in a form that does not become a second key leaves the ledger where it is.
    """
    addressed = messages.withColumnsRenamed({"transfer_id": "id", "request_id": "named_request_id"})
    same_request = F.coalesce(F.col("request_id") == F.col("named_request_id"), F.lit(False))
    return transfers.join(addressed, "id").where(same_request).drop("named_request_id")


def reduced(known: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a large table that may match the few wanted ones.

    A semi or outer join can only build its hash table from the right, which would be the large table; this one builds it
    from the wanted keys. Ids are unique, so they stand for longer keys and match how snapshots are bucketed.
    """
    keys = ["id"] if "id" in on else on
    return known.join(wanted.select(*keys).distinct(), keys, "left_semi")


def existing(wanted: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """The few wanted rows that a large table knows."""
    return wanted.join(reduced(known.select(*on), wanted, on), on, "left_semi")


def missing(wanted: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """The few wanted rows that a large table does not know."""
    return wanted.join(reduced(known.select(*on), wanted, on), on, "left_anti")


def parent_priority(messages: DataFrame, transfers: DataFrame) -> DataFrame:
    """Messages with the priority and request of the transfer they are about; null if it is unknown."""
    named = messages.select(F.col("transfer_id").alias("id"))
    parents = reduced(transfers, named, ["id"]).select(
        F.col("id").alias("transfer_id"),
        F.col("request_id").alias("parent_request_id"),
        "priority",
    )
    return messages.join(parents, "transfer_id", "left")


def with_manifests(copies: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Copy requests with what is known of their source and target object; nulls where there is none."""
    from_side = source.select(
        F.col("path").alias("source_path"),
        F.lit(True).alias("source_exists"),
        F.col("size").alias("source_size"),
        F.col("md5").alias("source_md5"),
        F.col("content_type").alias("source_type"),
    )
    to_side = target.select(
        F.col("path").alias("target_path"),
        F.lit(True).alias("target_exists"),
        F.col("size").alias("target_size"),
        F.col("md5").alias("target_md5"),
    )
    return (
        copies.join(from_side, "source_path", "left")
        .join(to_side, "target_path", "left")
        .withColumns(
            {
                "source_exists": F.coalesce("source_exists", F.lit(False)),
                "target_exists": F.coalesce("target_exists", F.lit(False)),
            }
        )
    )


def orphans(transfers: DataFrame, requests: DataFrame) -> DataFrame:
    """Transfers whose request is not in the ledger; a sound ledger has none."""
    return transfers.join(requests.select(F.col("id").alias("request_id")), "request_id", "left_anti")
