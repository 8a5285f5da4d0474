from conftest import at, keyed
from pyspark.sql import functions as F

from haulbook.plans.admission import admit, next_pending, slots


def ids(frame):
    return sorted(row.id for row in frame.select("id").collect())


def test_up_to_the_cap(two_requests, now):
    transfers, requests = two_requests
    admitted = admit(transfers, requests, 3, now)
    rows = admitted.collect()
    assert len(rows) == 3
    assert {(row.status, row.submitted_at, row.updated_at, row.steps_run) for row in rows} == {
        ("submitted", at(9000), None, -1)
    }


def test_everything_if_there_is_room(two_requests, now):
    assert admit(*two_requests, 100, now).count() == 30


def test_over_the_cap_admits_nothing(all_states, now):
    transfers, requests = all_states
    assert slots(transfers, 3) == 0
    assert admit(transfers, requests, 3, now).count() == 0


def test_in_progress_counts_towards_the_cap(all_states):
    in_flight = all_states[0].where("status IN ('submitted', 'inprogress')").count()
    assert in_flight == 11
    assert slots(all_states[0], in_flight + 2) == 2


def test_higher_priority_first(make, now):
    rows = [{"id": f"t{n}", "request": "R1", "priority": 5 if n in (3, 4, 6, 8) else 0} for n in range(10)]
    transfers, requests = make.transfers(rows), make.requests(R1=0)
    assert ids(admit(transfers, requests, 4, now)) == ["t3", "t4", "t6", "t8"]
    assert ids(admit(transfers, requests, 5, now)) == ["t0", "t3", "t4", "t6", "t8"]


def test_earlier_request_first_among_equals(two_requests, make, now):
    transfers, _ = two_requests
    assert set(keyed(admit(transfers, make.requests(R1=2, R2=1), 20, now), "request_id").values()) == {"R2"}
    assert set(keyed(admit(transfers, make.requests(R1=1, R2=2), 10, now), "request_id").values()) == {"R1"}


def test_one_request_with_most_rows_against_brute_force(spark):
    """Two in three rows belong to one request of the lowest admitted priority."""
    rows = spark.range(6000).select(
        F.lpad(F.col("id").cast("string"), 5, "0").alias("id"),
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("request_id"),
        F.lit("pending").alias("status"),
        (F.col("id") % 7 % 2).cast("smallint").alias("priority"),
    )
    requests = rows.select(F.col("request_id").alias("id")).distinct()
    requests = requests.withColumn("received_at", F.timestamp_millis(F.crc32("id") % 10).cast("timestamp_ntz"))
    joined = rows.join(requests.withColumnRenamed("id", "request_id"), "request_id")
    for count in (1, 1000, 2571, 2572, 4000, 5999):
        expected = joined.orderBy(F.desc("priority"), "received_at", "id").limit(count)
        assert ids(next_pending(rows, requests, count)) == ids(expected), count
