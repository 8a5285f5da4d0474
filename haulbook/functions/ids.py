"""Deterministic ids: a retried task or a replayed batch derives the same ones again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transfer_id(request_id: Column, ordinal: Column) -> Column:
    """Id of the transfer at a position of a bulk request."""
    return F.md5(F.concat_ws(":", request_id, ordinal.cast("string")))


def child_id(parent_id: Column, arrival: Column, ordinal: Column) -> Column:
    """Id of a child transfer, from its parent, the message that expanded it and its position there."""
    return F.md5(F.concat_ws(":", parent_id, arrival.cast("string"), ordinal.cast("string")))
