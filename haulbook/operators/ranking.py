"""Exact ranks and pages without a global sort and without moving the ranked rows to the driver.

`cut_at` finds the key of the k-th row in an order by narrowing a range: each pass counts rows per bucket of the
current range and goes on inside the bucket that holds the k-th row. A pass is one partial aggregation over the key
columns and hands the driver at most a few thousand counts. Taking the first k rows is then a plain filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets per pass; also the most counts a pass over numbers or times returns.
BUCKETS = 4096
#: A range with at most this many distinct values is listed instead of narrowed further.
SMALL = 4096
#: Pages that end within this many rows use Spark's top-k, whose result passes through the driver.
TOP_K_ROWS = 10_000


@dataclass(frozen=True)
class Key:
    """A column to order by."""

    column: str
    descending: bool = False

    @property
    def sort(self) -> Column:
        return F.col(self.column).desc() if self.descending else F.col(self.column).asc()


@dataclass(frozen=True)
class Cut:
    """The key of one row: everything up to and including it is covered."""

    keys: tuple[Key, ...]
    values: tuple[Column, ...]

    @property
    def covers(self) -> Column:
        condition = F.lit(True)
        for key, value in reversed(list(zip(self.keys, self.values))):
            column = F.col(key.column)
            before = column > value if key.descending else column < value
            condition = before | ((column == value) & condition)
        return condition


def cut_at(rows: DataFrame, keys: list[Key], rank: int, weight: str | None = None) -> tuple[Cut | None, int]:
    """Key of the row at ``rank`` (from 1), and how many rows with that key are still within the rank.

    The cut is None if there are no more than ``rank`` rows, so that all of them are within. Key columns must not be
    null; with ``weight`` a row stands for that many rows.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    values: list[Column] = []
    for key in keys:
        value, before, total = _value_at(rows, key, rank, amount)
        if not values and total <= rank:
            return None, rank
        rank -= before
        values.append(value)
        rows = rows.where(F.col(key.column) == value)
    return Cut(tuple(keys), tuple(values)), rank


def _value_at(rows: DataFrame, key: Key, rank: int, amount: Column) -> tuple[Column | None, int, int]:
    """The key value of the row at ``rank``, the number of rows before that value, and the number of all rows."""
    data_type = rows.schema[key.column].dataType
    column = F.col(key.column)
    measures = [
        amount.alias("n"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
        F.approx_count_distinct(column).alias("distinct"),
    ]

    def counts_per(bucket: Column) -> list[Row]:
        counts = rows.groupBy(bucket.alias("bucket")).agg(*measures).collect()
        return sorted(counts, key=lambda row: _sort_key(row["low"]), reverse=key.descending)

    if isinstance(data_type, (T.ByteType, T.ShortType)):
        # The type itself bounds how many values there are.
        counts = counts_per(column)
    else:
        counts = [rows.agg(*measures).first()]
    total = sum(row["n"] or 0 for row in counts)
    if total < rank:
        return None, 0, total
    skipped = 0
    while True:
        for row in counts:
            if skipped + row["n"] >= rank:
                break
            skipped += row["n"]
        low, high = row["low"], row["high"]
        if low == high:
            return F.lit(low).cast(data_type), skipped, total
        rows = rows.where(column.between(F.lit(low).cast(data_type), F.lit(high).cast(data_type)))
        if row["distinct"] <= SMALL:
            counts = counts_per(column)
        elif isinstance(data_type, T.StringType):
            counts = counts_per(F.substr(column, F.lit(1), F.lit(_common_prefix(low, high) + 2)))
        else:
            counts = counts_per(_bucket_of(column, F.lit(low).cast(data_type), F.lit(high).cast(data_type)))


def _bucket_of(column: Column, low: Column, high: Column) -> Column:
    # Differences first: they are exact, and the bucket number is monotone in them.
    width = high - low
    return F.width_bucket(column - low, width - width, width, F.lit(BUCKETS))


def _sort_key(value):
    # Spark orders strings by their bytes.
    return value.encode() if isinstance(value, str) else value


def _common_prefix(low: str, high: str) -> int:
    length = 0
    for one, other in zip(low, high):
        if one != other:
            break
        length += 1
    return length


def first_rows(rows: DataFrame, keys: list[Key], count: int) -> DataFrame:
    """The first ``count`` rows of a total order, unsorted."""
    if count <= 0:
        return rows.where(F.lit(False))
    cut, _ = cut_at(rows, keys, count)
    return rows if cut is None else rows.where(cut.covers)


def page(rows: DataFrame, keys: list[Key], offset: int, limit: int | None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order, sorted; empty beyond the end or with limit 0.

    Without a limit all rows from ``offset`` on.
    """
    order = [key.sort for key in keys]
    if limit is not None and limit <= 0:
        return rows.where(F.lit(False))
    if limit is not None and offset + limit <= TOP_K_ROWS:
        return rows.orderBy(*order).offset(offset).limit(limit)
    conditions = []
    if offset > 0:
        start, _ = cut_at(rows, keys, offset)
        if start is None:
            return rows.where(F.lit(False))
        conditions.append(~start.covers)
    end = None if limit is None else cut_at(rows, keys, offset + limit)[0]
    if end is not None:
        conditions.append(end.covers)
    return reduce(DataFrame.where, conditions, rows).orderBy(*order)
