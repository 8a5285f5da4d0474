"""Row selections over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.schemas import IN_FLIGHT


def with_ids(rows: DataFrame, ids: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Rows whose key is in a frame of keys; Spark broadcasts the keys if they turn out to be few."""
    return rows.join(ids, on=on, how="left_semi")


def where_all(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every given condition; None stands for an option that was left out."""
    for condition in conditions:
        if condition is not None:
            rows = rows.where(condition)
    return rows


def accepts_progress(status: Column, steps_run: Column, step: Column) -> Column:
    """Only in-flight transfers take progress, and only a later step than the one they are at."""
    return status.isin(*IN_FLIGHT) & (steps_run < step)


def undone(steps: DataFrame) -> DataFrame:
    """Steps that go on: to the progress topic."""
    return steps.where(~F.col("is_done"))


def done(steps: DataFrame) -> DataFrame:
    """Steps that ended a transfer: to the result topic."""
    return steps.where(F.col("is_done"))
