"""Reports: request summaries and transfer details, paged or looked up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.operators.aggregates import status_map, summaries
from haulbook.operators.filters import where_all, with_ids
from haulbook.operators.joins import missing, reduced
from haulbook.operators.ranking import Key, page
from haulbook.plans.control import NOT_FOUND, TRANSFER
from haulbook.schemas import STATUSES

#: Rows of a page unless asked otherwise.
DEFAULT_LIMIT = 20

#: Detail columns and the ledger columns they show.
DETAILS = {
    "id": "id",
    "status": "status",
    "priority": "priority",
    "request_body": "body",
    "submitted_at": "submitted_at",
    "updated_at": "updated_at",
    "reported_info": "info",
    "steps_run": "steps_run",
}


@dataclass(frozen=True)
class Page:
    """Sorted rows of a page, and how many rows there are on all pages."""

    items: DataFrame
    total: int


@dataclass(frozen=True)
class Lookup:
    """Rows that were asked for, and the keys that do not exist."""

    found: DataFrame
    rejected: DataFrame


def details(transfers: DataFrame) -> DataFrame:
    return transfers.select(*[F.col(column).alias(name) for name, column in DETAILS.items()])


def with_status_map(rows: DataFrame) -> DataFrame:
    """Summaries with their six counts as one map."""
    return rows.withColumn("status_counts", status_map()).drop(*STATUSES)


def page_of_requests(requests: DataFrame, offset: int, limit: int, newest_first: bool = True) -> DataFrame:
    """A page of requests by arrival; equal arrivals are ordered by id."""
    return page(requests, [Key("received_at", newest_first), Key("id", newest_first)], offset, limit)


def list_requests(
    transfers: DataFrame,
    requests: DataFrame,
    offset: int = 0,
    limit: int = DEFAULT_LIMIT,
    newest_first: bool = True,
) -> Page:
    """Summaries of a page of requests, sorted; the page is taken before anything is aggregated.

    Requests without transfers count in the total and take their place on a page, but have no summary.
    """
    chosen = page_of_requests(requests, offset, limit, newest_first)
    own = transfers.join(chosen.select(F.col("id").alias("request_id")), "request_id", "left_semi")
    order = [Key("received_at", newest_first).sort, Key("id", newest_first).sort]
    return Page(summaries(own, chosen).orderBy(*order), requests.count())


def request_status(transfers: DataFrame, requests: DataFrame, ids: DataFrame) -> Lookup:
    """Summaries of the requests in a frame of ids."""
    chosen = with_ids(requests, ids)
    own = transfers.join(chosen.select(F.col("id").alias("request_id")), "request_id", "left_semi")
    unknown = missing(ids, requests, ["id"])
    return Lookup(
        summaries(own, chosen),
        unknown.select(F.col("id").alias("request_id"), F.lit(NOT_FOUND).alias("reason")),
    )


def list_transfers(
    transfers: DataFrame,
    request_id: str,
    offset: int = 0,
    limit: int | None = DEFAULT_LIMIT,
    descending: bool = False,
    status: str | None = None,
) -> Page:
    """Details of a page of one request's transfers by id, optionally of one state; without a limit, of all."""
    wanted = None if status is None else F.col("status") == status
    rows = where_all(transfers, F.col("request_id") == request_id, wanted)
    return Page(details(page(rows, [Key("id", descending)], offset, limit)), rows.count())


def transfer_details(transfers: DataFrame, ids: DataFrame) -> Lookup:
    """Details of the transfers in a frame of (request_id, id)."""
    transfers = reduced(transfers, ids, TRANSFER)
    unknown = missing(ids, transfers, TRANSFER)
    return Lookup(
        details(transfers.join(ids.select(*TRANSFER), TRANSFER, "left_semi")),
        unknown.select(*TRANSFER, F.lit(NOT_FOUND).alias("reason")),
    )
