import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from haulbook.schemas import PROGRESS, REQUESTS, RESULTS, TRANSFERS  # noqa: E402
from haulbook.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def now():
    return F.lit("1970-01-01 00:00:09").cast("timestamp_ntz")


def at(millis: int):
    import datetime

    return datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=millis)


class Fixture:
    """Requests with numbered transfers, built the way the cases need them."""

    def __init__(self, spark):
        self.spark = spark

    def requests(self, **received):
        rows = [(name, at(millis)) for name, millis in received.items()]
        return self.spark.createDataFrame(rows, REQUESTS)

    def transfers(self, rows):
        """Rows are dicts with an id and a request; the rest is as for a new transfer."""
        full = [
            (
                row["id"],
                row["request"],
                row.get("status", "pending"),
                row.get("body", '{"i":0}'),
                row.get("submitted_at"),
                row.get("updated_at"),
                row.get("info"),
                row.get("steps", -1),
                row.get("priority", 0),
            )
            for row in rows
        ]
        return self.spark.createDataFrame(full, TRANSFERS)

    def progress(self, rows):
        return self.spark.createDataFrame([(*row, number) for number, row in enumerate(rows)], PROGRESS)

    def results(self, rows):
        return self.spark.createDataFrame([(*row, number) for number, row in enumerate(rows)], RESULTS)


@pytest.fixture(scope="session")
def make(spark):
    return Fixture(spark)


@pytest.fixture(scope="session")
def two_requests(make):
    """R1 with 10 and R2 with 20 pending transfers, R1 received first."""
    rows = [{"id": f"R1-{n:02d}", "request": "R1", "body": f'{{"i":{n}}}'} for n in range(10)]
    rows += [{"id": f"R2-{n:02d}", "request": "R2", "body": f'{{"i":{n}}}'} for n in range(20)]
    return make.transfers(rows), make.requests(R1=1234, R2=1235)


@pytest.fixture(scope="session")
def all_states(make):
    """The same transfers, their states in turn."""
    from haulbook.schemas import STATUSES

    rows = [{"id": f"R1-{n:02d}", "request": "R1", "status": STATUSES[n % 6], "steps": 3} for n in range(10)]
    rows += [{"id": f"R2-{n:02d}", "request": "R2", "status": STATUSES[n % 6], "steps": 3} for n in range(20)]
    return make.transfers(rows), make.requests(R1=1234, R2=1235)


def keyed(frame, *columns, key="id"):
    """Rows as a dict from key to a column or tuple of columns."""
    rows = frame.select(key, *columns).collect()
    return {row[0]: row[1] if len(columns) == 1 else tuple(row[1:]) for row in rows}
